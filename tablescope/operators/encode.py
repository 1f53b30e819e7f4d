"""Categorical encoding."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import fold_nan, quoted, text_columns
from ..session import in_parallel, materialize
from .ranks import value_ranks
from .value_counts import distinct_counts, typed_counts

SMALL_DICTIONARY = 100_000      # values, and
SMALL_BYTES = 16 * 1024 * 1024  # bytes, of a dictionary that may be broadcast
HOT_SHARE = 1_000               # a value is hot when it fills more than 1/1000 of the rows


def encode_label(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Replace each text value by its 0-based rank among the sorted values.

    Null takes part as the text 'nan'. Small dictionaries are broadcast. For a
    large one the hot values (at most a thousand) are still broadcast, and only
    the remaining, evenly spread rows are shuffled to it.
    """
    df = fold_nan(df)
    columns = text_columns(df) if columns is None else columns
    key_of = lambda c: F.coalesce(quoted(c).cast("string"), F.lit("nan"))       # noqa: E731
    learn = lambda c, source=df: materialize(value_ranks(source, key_of(c)).select(     # noqa: E731
        F.col("value").alias("label_value"), F.col("index").cast("bigint").alias("label_code"), "count"), "labels")
    # The dictionaries do not depend on each other: all are learnt from the input, before any of them is joined.
    dictionaries = in_parallel(df.sparkSession, *[partial(learn, c) for c in columns]) if columns else []
    for c, ranked in zip(columns, dictionaries):
        key = key_of(c)
        tagged = df.withColumn("label_value", key)
        size = ranked.agg(F.count("*").alias("values"), F.sum("count").alias("rows"), F.sum(F.octet_length("label_value")).alias("bytes")).first()
        if size["values"] <= SMALL_DICTIONARY and (size["bytes"] or 0) <= SMALL_BYTES:
            joined = tagged.join(F.broadcast(ranked.drop("count")), "label_value")
        else:
            hot = ranked.where(F.col("count") * HOT_SHARE > size["rows"]).drop("count")
            hot_values = [r[0] for r in hot.select("label_value").collect()]        # fewer than HOT_SHARE
            is_hot = F.col("label_value").isin(hot_values) if hot_values else F.lit(False)
            cold = tagged.where(~is_hot).join(ranked.drop("count"), "label_value")
            joined = tagged.where(is_hot).join(F.broadcast(hot), "label_value").unionByName(cold)
        df = joined.select([F.col("label_code").alias(x) if x == c else quoted(x) for x in df.columns])
    return df


def encode_onehot(df: DataFrame, max_categories: int = 20) -> DataFrame:
    """Text columns with at most ``max_categories`` values become 0/1 columns
    ``column_value`` (first sorted value dropped, null all zero) at the end; the
    others are label-encoded in place."""
    df = fold_nan(df)
    text = text_columns(df)
    if not text:
        return df
    sizes = {r["column"]: r["unique_count"] for r in distinct_counts(df, text).collect()}     # one row per column
    small = [c for c in text if sizes.get(c, 0) <= max_categories]
    values: dict[str, list[str]] = {c: [] for c in small}
    if small:
        [(_, counts)] = typed_counts(df, small)
        for r in counts.select("column", "value").collect():    # at most max_categories rows per column
            values[r["column"]].append(r["value"])
    kept = [c for c in df.columns if c not in small]
    flags = [F.when(quoted(c) == v, 1).otherwise(0).cast("bigint").alias(f"{c}_{v}")
             for c in small for v in sorted(values[c])[1:]]
    out = df.select([quoted(c) for c in kept] + flags)
    large = [c for c in text if c not in small]
    return encode_label(out, large) if large else out


def encode_categorical(df: DataFrame, method: str = "onehot", max_categories: int = 20) -> DataFrame:
    if method == "onehot":
        return encode_onehot(df, max_categories)
    if method == "label":
        return encode_label(df)
    return df
