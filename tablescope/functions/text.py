"""Text and display column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import quoted, rounded


def fixed(x: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals, rounded half-up; numbers beyond a decimal's range keep all their digits."""
    exact = F.round(x.try_cast("decimal(38,10)"), digits).try_cast(f"decimal(38,{digits})").cast("string")
    return F.coalesce(exact, F.format_string(f"%.{digits}f", x.cast("double")))


def format_number(x: Column) -> Column:
    """Short display form: 1.2M, 3.4K, 5.6, 0.07, 0.001."""
    x = x.cast("double")
    size = F.abs(x)
    return (
        F.when(size >= 1_000_000, F.concat(fixed(x / 1_000_000, 1), F.lit("M")))
        .when(size >= 1_000, F.concat(fixed(x / 1_000, 1), F.lit("K")))
        .when(size >= 1, fixed(x, 1))
        .when(size >= 0.01, fixed(x, 2))
        .otherwise(fixed(x, 3))
    )


def format_bytes(size: Column, smallest: str = "B") -> Column:
    """Byte count with a binary unit and one decimal.

    ``smallest="KB"`` is the repository-listing form, which never shows bytes.
    """
    kb, mb, gb = 1024, 1024**2, 1024**3
    text = (
        F.when(size < mb, F.concat(fixed(size / kb, 1), F.lit(" KB")))
        .when(size < gb, F.concat(fixed(size / mb, 1), F.lit(" MB")))
        .otherwise(F.concat(fixed(size / gb, 1), F.lit(" GB")))
    )
    if smallest == "KB":
        return text
    return F.when(size < kb, F.concat(size.cast("string"), F.lit(" B"))).otherwise(text)


def stable_id(prefix: str, natural_key: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.md5(natural_key.cast("binary")), 1, 12))


def slug_title(slug: Column) -> Column:
    """Last path part, separators to blanks, each word capitalised."""
    return F.initcap(F.translate(F.element_at(F.split(slug, "/"), -1), "-_", "  "))


def truncate_label(value: Column, length: int = 30) -> Column:
    return F.substring(value.cast("string"), 1, length)


def json_safe(df: DataFrame) -> DataFrame:
    """Columns ready for JSON: floats to 4 decimals with NaN and infinities as
    null, timestamps and dates as ISO text, nested values as JSON text."""
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = rounded(c.cast("double"), 4)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(c, "SSSSSS")
            c = F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(out)


# An ISO timestamp only has a usable age when it carries a zone.
_ZONED = r"[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"


def age_days(stamp: Column, as_of: Column) -> Column:
    """Whole days from a zoned ISO timestamp to ``as_of``; null when the text is
    empty, has no zone or cannot be read."""
    moment = F.when(stamp.rlike(_ZONED), F.try_to_timestamp(stamp))
    seconds = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(moment)
    return F.floor(seconds / F.lit(86_400_000_000.0)).cast("bigint")
