"""Missing-value handling: drop, mean, median, mode, neighbours, chained, smart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import fold_nan, numeric_columns, quoted, replace_columns, text_columns
from ..session import materialize
from .chained import impute_chained
from .neighbours import nearest, vector
from .quantiles import medians
from .stats import column_stats
from .value_counts import modes

SMALL_LOOKUP = 2_000_000      # numbers in a lookup table that may be broadcast (16 MB)


def drop_rows(df: DataFrame) -> DataFrame:
    return fold_nan(df).na.drop("any")


def drop_cols(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop columns whose share of nulls exceeds ``threshold``."""
    df = fold_nan(df)
    stats = column_stats(df, [], ())
    return df.select([quoted(c) for c in df.columns if stats.rows == 0 or (stats.rows - stats.count[c]) / stats.rows <= threshold])


def _fill(df: DataFrame, values: dict[str, object], as_double: set[str] = frozenset()) -> DataFrame:
    """One projection that fills nulls with learnt constants."""
    changed = {}
    for c, v in values.items():
        if v is None:
            continue
        col = quoted(c).cast("double") if c in as_double else quoted(c)
        kind = "double" if c in as_double else df.schema[c].dataType
        changed[c] = F.coalesce(col, F.lit(v).cast(kind))
    return replace_columns(df, changed)


def _with_gaps(df: DataFrame, columns: list[str]) -> list[str]:
    stats = column_stats(df, [], (), columns)
    return [c for c in columns if stats.count[c] < stats.rows]


def _text_modes(df: DataFrame, gaps: list[str]) -> dict[str, object]:
    text = [c for c in text_columns(df) if c in gaps]
    found = modes(df, text) if text else {}
    return {c: found.get(c, "Unknown") for c in text}


def fill_mean(df: DataFrame) -> DataFrame:
    """Numbers get their mean, text its mode ('Unknown' when all null)."""
    df = fold_nan(df)
    gaps = _with_gaps(df, df.columns)
    numeric = [c for c in numeric_columns(df) if c in gaps]
    stats = column_stats(df, numeric, ("mean",), [])
    values = {c: stats.get(c, "mean") for c in numeric}
    return _fill(df, {**values, **_text_modes(df, gaps)}, set(numeric))


def fill_median(df: DataFrame) -> DataFrame:
    """Numbers get their exact median, text its mode ('Unknown' when all null)."""
    df = fold_nan(df)
    gaps = _with_gaps(df, df.columns)
    numeric = [c for c in numeric_columns(df) if c in gaps]
    return _fill(df, {**medians(df, numeric), **_text_modes(df, gaps)}, set(numeric))


def fill_mode(df: DataFrame) -> DataFrame:
    """Every column gets its most frequent value, the smallest on ties."""
    df = fold_nan(df)
    gaps = _with_gaps(df, df.columns)
    return _fill(df, modes(df, gaps)) if gaps else df


def impute_knn(df: DataFrame, columns: list[str] | None = None, k: int = 5, **block_sizes) -> DataFrame:
    """Numeric gaps get the mean of the k nearest rows that have the value.

    Distances are NaN-Euclidean over ``columns`` (all numeric ones by default),
    which come back as doubles. Ties go to the smaller value. A gap without any
    comparable row gets the column mean.
    """
    df = fold_nan(df)
    columns = numeric_columns(df) if columns is None else columns
    stats = column_stats(df, columns, ("mean",), columns)
    gaps = [c for c in columns if 0 < stats.count[c] < stats.rows]
    df = replace_columns(df, {c: quoted(c).cast("double") for c in columns})
    if not gaps:
        return df
    columns = [c for c in columns if stats.count[c] > 0]
    p, k = len(columns), max(1, min(k, stats.rows - 1))
    v = vector([quoted(c) for c in columns])
    any_gap = F.lit(False)
    for c in gaps:
        any_gap = any_gap | quoted(c).isNull()

    everything = df.select(v.alias("x")).groupBy("x").agg(F.count("*").alias("cnt")).withColumn("grp", F.lit(""))
    open_targets = F.array_compact(F.array(*[F.when(quoted(c).isNull(), F.lit(columns.index(c))) for c in gaps]))
    queries = (df.where(any_gap).select(v.alias("q"), open_targets.alias("targets")).distinct()
               .select("q", F.explode("targets").alias("target"), F.lit("").alias("grp")))
    found = nearest(queries, everything, p, k, **block_sizes)
    value = F.get("x", F.col("target"))
    filled = found.groupBy("q", "target").agg((F.sum(value * F.col("weight")) / F.sum("weight")).alias("value"))
    wide = filled.groupBy("q").agg(*[F.max(F.when(F.col("target") == columns.index(c), F.col("value"))).alias(f"fill_{i}")
                                     for i, c in enumerate(gaps)])
    wide = _maybe_broadcast(wide.withColumnRenamed("q", "knn_q"), SMALL_LOOKUP // (p + len(gaps)))

    # Only rows with a gap take part in the join; the others pass straight through.
    patched = df.where(any_gap).withColumn("knn_q", v).join(wide, "knn_q", "left")
    out = {c: F.coalesce(quoted(c), F.col(f"fill_{i}"), F.lit(stats.get(c, "mean"))) for i, c in enumerate(gaps)}
    patched = patched.select([out[c].alias(c) if c in out else quoted(c) for c in df.columns])
    return df.where(~any_gap).unionByName(patched)


def _maybe_broadcast(table: DataFrame, most: int) -> DataFrame:
    """Freeze a lookup table; broadcast it only when it has at most ``most`` rows."""
    frozen = materialize(table, "lookup")
    return F.broadcast(frozen) if frozen.limit(most + 1).count() <= most else frozen


def _fill_text_with_mode(df: DataFrame) -> DataFrame:
    text = _with_gaps(df, text_columns(df))
    return _fill(df, modes(df, text)) if text else df


def fill_knn(df: DataFrame, k: int = 5) -> DataFrame:
    """Neighbours for numbers, mode for text."""
    return _fill_text_with_mode(impute_knn(df, k=k))


def fill_chained(df: DataFrame, max_iter: int = 10) -> DataFrame:
    """Chained regressions for numbers, mode for text."""
    return _fill_text_with_mode(impute_chained(df, max_iter=max_iter))


def impute_smart(df: DataFrame) -> DataFrame:
    """Per column by its share of gaps: over half - dropped; over 5% -
    neighbours within just those numeric columns, mode for text; else median or mode."""
    df = fold_nan(df)
    stats = column_stats(df, [], ())
    share = {c: (stats.rows - stats.count[c]) / stats.rows if stats.rows else 0.0 for c in df.columns}
    df = df.select([quoted(c) for c in df.columns if share[c] <= 0.5])
    numeric, text = numeric_columns(df), text_columns(df)
    near = [c for c in numeric if share[c] > 0.05]
    some = [c for c in df.columns if 0 < share[c] <= 0.05]
    mode_cols = [c for c in some if c not in numeric] + [c for c in text if share[c] > 0.05]
    middle = [c for c in some if c in numeric]
    # Learn every constant before the neighbour step: the columns are disjoint.
    values = {**(modes(df, mode_cols) if mode_cols else {}), **medians(df, middle)}
    out = _fill(df, values, set(middle))
    return impute_knn(out, near) if near else out


STRATEGIES = ("drop_rows", "drop_cols", "mean", "median", "mode", "knn", "iterative", "smart")


def handle_missing(df: DataFrame, strategy: str = "smart", threshold: float = 0.5, n_neighbors: int = 5, max_iter: int = 10) -> DataFrame:
    """Unknown strategies fall back to ``smart``."""
    if strategy == "drop_rows":
        return drop_rows(df)
    if strategy == "drop_cols":
        return drop_cols(df, threshold)
    if strategy == "mean":
        return fill_mean(df)
    if strategy == "median":
        return fill_median(df)
    if strategy == "mode":
        return fill_mode(df)
    if strategy == "knn":
        return fill_knn(df, n_neighbors)
    if strategy == "iterative":
        return fill_chained(df, max_iter)
    return impute_smart(df)
