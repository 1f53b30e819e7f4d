"""Long-form value counts: (column, value, count) for many columns at once.

Columns are unpivoted per data type, so values keep their type and no cast to
text happens before the shuffle. Every count is combined map-side, so a value
that fills a third of the table costs one row per map task. Each data type
reads only its own columns from the source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import is_nested, quoted


def _typed(df: DataFrame, name: str) -> tuple[Column, str]:
    field = df.schema[name]
    c = quoted(name)
    if is_nested(field):
        return F.to_json(c), "string"
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double")) + F.lit(0.0), "double"
    if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint"), "bigint"
    return c, field.dataType.simpleString()


def _by_type(df: DataFrame, columns: list[str] | None) -> dict[str, list[Column]]:
    groups: dict[str, list[Column]] = {}
    for name in columns if columns is not None else df.columns:
        expr, kind = _typed(df, name)
        groups.setdefault(kind, []).append(expr.alias(name))
    return groups


def families(df: DataFrame, columns: list[str] | None = None) -> list[tuple[str, DataFrame]]:
    """One (type, DataFrame[column, value]) per data type, nulls removed."""
    out = []
    for kind, exprs in _by_type(df, columns).items():
        part = df.select(*exprs)
        values = [quoted(c) for c in part.columns]
        long = part.unpivot([], values, "column", "value")
        out.append((kind, long.where(F.col("value").isNotNull())))
    return out


def typed_counts(df: DataFrame, columns: list[str] | None = None) -> list[tuple[str, DataFrame]]:
    return [(kind, long.groupBy("column", "value").agg(F.count("*").alias("count")))
            for kind, long in families(df, columns)]


def counted(value: Column, kind: str, digest: bool) -> Column:
    """What tells values apart: the value itself, or with ``digest`` the SHA-256 of a text, of every length. Counting distinct
    documents by digest shuffles 64 characters per document, not the documents."""
    return F.sha2(value, 256) if digest and kind == "string" else value


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, count) with values as text."""
    parts = [c.select("column", F.col("value").cast("string").alias("value"), "count")
             for _, c in typed_counts(df, columns)]
    return reduce(DataFrame.unionByName, parts)


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approx: bool = False, digest: bool = False) -> DataFrame:
    """(column, unique_count) of non-null values: exact, of texts by their digests, or estimated."""
    if approx:
        parts = [long.groupBy("column").agg(F.approx_count_distinct("value").alias("unique_count"))
                 for _, long in families(df, columns)]
    else:
        parts = [_distinct(df.select(*exprs), kind, digest) for kind, exprs in _by_type(df, columns).items()]
    return reduce(DataFrame.unionByName, parts)


def _distinct(part: DataFrame, kind: str, digest: bool) -> DataFrame:
    """Exact distinct counts of columns of one type, told apart by their places. Integers are kept as words of 64
    neighbours with a bit for each one seen, so that keys and other dense numbers take one row for up to 64 values."""
    names = part.columns
    cells = [x for i, c in enumerate(names) for x in (F.lit(i), quoted(c))]
    long = part.select(F.stack(F.lit(len(names)), *cells).alias("place", "value")).where(F.col("value").isNotNull())
    if kind == "bigint":
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("value").bitwiseAND(63).cast("int"))
        words = long.groupBy("place", F.shiftright("value", 6).alias("word")).agg(F.bit_or(bit).alias("seen"))
        found = words.groupBy("place").agg(F.sum(F.bit_count("seen")).alias("unique_count"))
    else:
        keys = long.groupBy("place", counted(F.col("value"), kind, digest).alias("key")).agg(F.lit(1))
        found = keys.groupBy("place").agg(F.count("*").alias("unique_count"))
    return found.select(F.array(*[F.lit(c) for c in names])[F.col("place")].alias("column"), "unique_count")


def most_common(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, mode, mode_count, non_null, unique_count).

    The mode is the most frequent value, the smallest one on ties in the order
    of the column's own type.
    """
    parts = []
    for _, counts in typed_counts(df, columns):
        top = F.min(F.struct((-F.col("count")).alias("rank"), F.col("value")))   # combines map-side
        parts.append(
            counts.groupBy("column")
            .agg(top.alias("top"), F.sum("count").alias("non_null"), F.count("*").alias("unique_count"))
            .select("column", F.col("top.value").cast("string").alias("mode"),
                    (-F.col("top.rank")).alias("mode_count"), "non_null", "unique_count")
        )
    return reduce(DataFrame.unionByName, parts)


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Mode per column as typed driver values (one per column)."""
    found: dict[str, object] = {}
    for _, counts in typed_counts(df, columns):
        rows = (
            counts.groupBy("column")
            .agg(F.min(F.struct((-F.col("count")).alias("rank"), F.col("value"))).alias("top"))
            .select("column", F.col("top.value").alias("value"))
        )
        found.update({r["column"]: r["value"] for r in rows.collect()})
    return found
