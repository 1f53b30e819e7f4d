"""Duplicate removal, column selection, scaling and outlier filters.

Every operator learns its parameters in one or a few aggregate jobs and then
returns a plain projection or filter, which stays lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import fold_nan, is_nested, numeric_columns, quoted, replace_columns
from .correlations import pair_correlations
from .quantiles import exact_quantiles, medians, quartiles
from .stats import column_stats
from .value_counts import distinct_counts


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each group of equal rows, null equal to null. Copies are
    combined map-side, so a much-repeated row costs one row per task."""
    return fold_nan(df).dropDuplicates()


def remove_correlated(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Of each pair with |r| above ``threshold`` drop the column further left."""
    df = fold_nan(df)
    if len(numeric_columns(df)) < 2:
        return df
    hit = pair_correlations(df).where(F.abs("value") > threshold).select("column1").distinct()
    gone = {r[0] for r in hit.collect()}                      # at most one row per column
    return df.select([quoted(c) for c in df.columns if c not in gone])


def drop_low_variance(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Drop near-constant columns.

    After z-scaling (null as 0) a column's variance is either 0 or n/(n-1), so
    any threshold up to 1 means: numeric columns that never change once null is
    0. A larger threshold, below n/(n-1) or not, is compared with those two
    values. Columns with at most one distinct value go as well.
    """
    df = fold_nan(df)
    numeric = numeric_columns(df)
    if not numeric:
        return df
    stats = column_stats(df, numeric, ("min", "max", "min_filled", "max_filled"), [])
    varying = stats.rows / (stats.rows - 1.0) if stats.rows > 1 else None
    gone = {c for c in numeric if stats.get(c, "min") == stats.get(c, "max")}
    for c in numeric:
        flat = stats.get(c, "min_filled") == stats.get(c, "max_filled")
        if varying is not None and (0.0 if flat else varying) < threshold:
            gone.add(c)
    # min = max finds the single-valued columns of any other orderable type without grouping.
    plain = [f.name for f in df.schema.fields if f.name not in numeric and not is_nested(f)]
    if plain:
        row = df.agg(*[x for i, c in enumerate(plain) for x in (F.min(quoted(c)).alias(f"a{i}"), F.max(quoted(c)).alias(f"b{i}"))]).first()
        gone |= {c for i, c in enumerate(plain) if row[f"a{i}"] == row[f"b{i}"]}
    nested = [f.name for f in df.schema.fields if is_nested(f)]
    if nested:
        few = {r["column"]: r["unique_count"] for r in distinct_counts(df, nested).collect()}
        gone |= {c for c in nested if few.get(c, 0) <= 1}
    return df.select([quoted(c) for c in df.columns if c not in gone])


def _chosen(df: DataFrame, columns: list[str] | None) -> list[str]:
    numeric = numeric_columns(df)
    return [c for c in columns if c in numeric] if columns else numeric


def scale_minmax(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0."""
    df = fold_nan(df)
    cols = _chosen(df, columns)
    stats = column_stats(df, cols, ("min", "max"), [])
    return _shift_scale(df, {c: (stats.get(c, "min"), _span(stats.get(c, "max"), stats.get(c, "min"))) for c in cols})


def scale_zscore(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    df = fold_nan(df)
    cols = _chosen(df, columns)
    stats = column_stats(df, cols, ("mean", "std_pop", "min", "max"), [])
    flat = lambda c: stats.get(c, "min") == stats.get(c, "max")
    return _shift_scale(df, {c: (stats.get(c, "min"), 1.0) if flat(c) else (stats.get(c, "mean"), stats.get(c, "std_pop")) for c in cols})


def scale_robust(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x - median) / interquartile range with exact quartiles; range 0 divides by 1."""
    df = fold_nan(df)
    cols = _chosen(df, columns)
    q = quartiles(df, cols)
    return _shift_scale(df, {c: (q[c][0.5], _span(q[c][0.75], q[c][0.25])) for c in cols})


def _span(high, low) -> float:
    return 1.0 if high is None or high == low else high - low


def _shift_scale(df: DataFrame, params: dict[str, tuple]) -> DataFrame:
    changed = {}
    for c, (shift, scale) in params.items():
        if shift is None:                       # an empty column stays empty
            changed[c] = quoted(c).cast("double")
        else:
            changed[c] = (quoted(c).cast("double") - F.lit(float(shift))) / F.lit(float(scale))
    return replace_columns(df, changed)


def normalize(df: DataFrame, method: str = "robust", columns: list[str] | None = None) -> DataFrame:
    """Unknown methods leave the table as it is."""
    chosen = {"minmax": scale_minmax, "zscore": scale_zscore, "robust": scale_robust}.get(method)
    return chosen(df, columns) if chosen else df


def outliers_iqr(df: DataFrame, threshold: float = 1.5, joint: bool = False) -> DataFrame:
    """Keep rows within ``threshold`` interquartile ranges, or null, in every numeric column.

    Columns are taken in order, each on the rows the previous ones left. With
    ``joint`` all limits come from the full table in one run.
    """
    df = fold_nan(df)
    numeric = numeric_columns(df)

    def keep(c, q):
        iqr = q[0.75] - q[0.25] if q[0.25] is not None else 0.0
        if not iqr > 0:
            return None
        x = quoted(c).cast("double")
        return x.between(q[0.25] - threshold * iqr, q[0.75] + threshold * iqr) | x.isNull()

    if joint:
        limits = exact_quantiles(df, {c: [0.25, 0.75] for c in numeric})
        for c in numeric:
            cond = keep(c, limits[c])
            df = df if cond is None else df.where(cond)
        return df
    for c in numeric:
        cond = keep(c, exact_quantiles(df, {c: [0.25, 0.75]})[c])
        df = df if cond is None else df.where(cond)
    return df


def outliers_zscore(df: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Keep rows whose |z| is below ``threshold``, or null, column after column.

    Nulls count as the median while mean and deviation are taken. A column that
    is constant then has no z-score, and its non-null rows all go.
    """
    df = fold_nan(df)
    for c in numeric_columns(df):
        x = quoted(c).cast("double")
        mid = medians(df, [c])[c]
        filled = F.coalesce(x, F.lit(mid)) if mid is not None else x
        row = df.agg(F.avg(filled).alias("m"), F.stddev_pop(filled).alias("s"), F.min(filled).alias("a"), F.max(filled).alias("b")).first()
        if row["a"] is None:
            continue
        if row["a"] == row["b"]:
            df = df.where(x.isNull())
        else:
            df = df.where(x.isNull() | (F.abs((x - F.lit(row["m"])) / F.lit(row["s"])) < threshold))
    return df


def remove_outliers(df: DataFrame, method: str = "iqr", threshold: float = 1.5, joint: bool = False) -> DataFrame:
    if method == "iqr":
        return outliers_iqr(df, threshold, joint)
    if method == "zscore":
        return outliers_zscore(df, threshold)
    return df
