"""Numeric column expressions and column-type tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EXACT = "decimal(38,10)"


def quoted(name: str) -> Column:
    """Column reference that is safe for names with dots, spaces or back-ticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def rounded(x: Column, digits: int, bounded: bool = False) -> Column:
    """Decimal half-up rounding; NaN and infinities become null.

    Going through a decimal gives the same digits on every engine, which a
    binary ``round`` does not. Values beyond the decimal's range are left as
    they are; ``bounded`` says there are none (scores, shares) and keeps the
    expression small.
    """
    if bounded:
        return F.round(x.try_cast(_EXACT), digits).cast("double")
    finite = F.when(F.abs(x) < F.lit(float("inf")), x)
    return F.coalesce(F.round(finite.try_cast(_EXACT), digits).cast("double"), finite)


def rounded_value(x: float | None, digits: int) -> float | None:
    """The driver-side twin of :func:`rounded`, for values already learnt."""
    from decimal import ROUND_HALF_UP, Decimal, localcontext

    if x is None or x != x or x in (float("inf"), float("-inf")):
        return None
    with localcontext(prec=400):        # any double has fewer digits
        ten = Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-10), ROUND_HALF_UP)
        return float(ten.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null instead of an error on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def adjusted_skew(x: Column) -> Column:
    """Bias-adjusted sample skewness (aggregate); 0 for a constant column."""
    n = F.count(x).cast("double")
    g1 = F.coalesce(F.skewness(x), F.when(n > 0, F.lit(0.0)))
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis (aggregate); 0 for a constant column."""
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.coalesce(value, F.lit(0.0)))


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.CharType, T.VarcharType))


def is_nested(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f)]


def fold_nan(df: DataFrame) -> DataFrame:
    """NaN counts as missing: turn it into null in every floating column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(
        [F.nanvl(quoted(c), F.lit(None).cast("double")).cast(df.schema[c].dataType).alias(c)
         if c in floats else quoted(c) for c in df.columns]
    )


def replace_columns(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """One projection that swaps the given columns and keeps order and names."""
    return df.select([changed[c].alias(c) if c in changed else quoted(c) for c in df.columns])
