"""Bias and fairness warnings for one table.

All numeric checks share two aggregates over the table and one exact-quantile
run; only per-column figures come back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import fold_nan, numeric_columns, quoted, rounded, rounded_value
from ..functions.text import fixed
from ..operators.quantiles import quartiles
from ..operators.stats import column_stats
from ..session import local_table
from .rules import SENSITIVE_PARTS

WARNINGS = ("dataset_id string, ord int, type string, severity string, title string, description string, "
            "affected_columns array<string>, suggestion string")
FIGURES = ("column string, position int, non_null bigint, skew double, outlier_pct double, same_pct double, "
           "min_filled double, max_filled double")


def _warning(dataset_id, ord_, kind, severity, title, text, columns, suggestion) -> dict:
    return {"dataset_id": dataset_id, "ord": ord_, "type": kind, "severity": severity, "title": title,
            "description": text, "affected_columns": columns, "suggestion": suggestion}


def numeric_figures(df: DataFrame) -> list[dict]:
    """Per numeric column: skew, share outside 1.5 IQR, share of the commonest value.

    A value that fills more than half of a column is its median, so counting
    the rows equal to the median finds every near-constant column exactly
    without grouping the values.
    """
    df = fold_nan(df)
    numeric = numeric_columns(df)
    if not numeric:
        return []
    stats = column_stats(df, numeric, ("skew", "min_filled", "max_filled"), numeric)
    quarts = quartiles(df, [c for c in numeric if stats.count[c] >= 10])
    aggs = []
    for i, c in enumerate(numeric):
        if c not in quarts:
            continue
        x, q = quoted(c).cast("double"), quarts[c]
        reach = 1.5 * (q[0.75] - q[0.25])
        aggs += [F.count(F.when((x < q[0.25] - reach) | (x > q[0.75] + reach), True)).alias(f"out{i}"),
                 F.count(F.when(x == q[0.5], True)).alias(f"same{i}")]
    counted = df.agg(*aggs).first() if aggs else None
    out = []
    for i, c in enumerate(numeric):
        n = stats.count[c]
        row = {"column": c, "position": df.columns.index(c), "non_null": n, "skew": None, "outlier_pct": None,
               "same_pct": None, "min_filled": stats.get(c, "min_filled"), "max_filled": stats.get(c, "max_filled")}
        if n >= 20:
            row["skew"] = stats.get(c, "skew")
            if quarts[c][0.75] != quarts[c][0.25]:
                row["outlier_pct"] = counted[f"out{i}"] / n * 100
        if n >= 10:
            row["same_pct"] = counted[f"same{i}"] / n * 100
        out.append(row)
    return out


def figures_table(df: DataFrame) -> DataFrame:
    return local_table(df.sparkSession, numeric_figures(df), FIGURES)


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """One row: classes, total, dominant and minority class with their shares."""
    counts = (df.select(quoted(target).cast("string").alias("value")).where(F.col("value").isNotNull())
              .groupBy("value").agg(F.count("*").alias("count")))
    order = F.struct((-F.col("count")).alias("neg"), F.col("value"))
    one = counts.agg(F.count("*").alias("classes"), F.sum("count").alias("total"), F.min(order).alias("top"), F.max(order).alias("low"))
    pct = lambda side: -F.col(side + ".neg") * 100.0 / F.col("total").cast("double")
    return one.where(F.col("classes") > 0).select(
        "classes", "total", F.col("top.value").alias("dominant"), F.col("low.value").alias("minority"),
        pct("top").alias("dominant_pct"), pct("low").alias("minority_pct"))


def class_imbalance(df: DataFrame, target: str, dataset_id: str = "table") -> DataFrame:
    """At most one warning when the largest class holds 70% or more."""
    top, low = F.col("dominant_pct"), F.col("minority_pct")
    times = top / F.greatest(low, F.lit(0.01))
    return class_balance(fold_nan(df), target).where((F.col("classes") >= 2) & (top >= 70)).select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(0).alias("ord"), F.lit("class_imbalance").alias("type"),
        F.when(top >= 80, "high").otherwise("medium").alias("severity"),
        F.concat(F.when(top >= 90, "Severely").when(top >= 80, "Strongly").otherwise("Moderately"),
                 F.lit(f" uneven classes in {target}")).alias("title"),
        F.concat(F.lit("Class "), F.col("dominant"), F.lit(" holds "), fixed(top, 1), F.lit("%, class "), F.col("minority"),
                 F.lit(" "), fixed(low, 1), F.lit("%: "), fixed(times, 1), F.lit(" to 1.")).alias("description"),
        F.array(F.lit(target)).alias("affected_columns"),
        F.lit("Oversample or weight the small classes and judge by F1 or AUC.").alias("suggestion"))


def _named(cols: list[tuple[str, float | None]], unit: str = "") -> str:
    return ", ".join(f"{c} ({v}{unit})" for c, v in cols[:4])


def _skewness(figures, dataset_id):
    strong = [(f["column"], rounded_value(f["skew"], 2)) for f in figures if f["skew"] is not None and abs(f["skew"]) > 3]
    some = [(f["column"], rounded_value(f["skew"], 2)) for f in figures if f["skew"] is not None and 2 < abs(f["skew"]) <= 3]
    out = []
    if strong:
        out.append(_warning(dataset_id, 1, "feature_skewness", "high", f"Very skewed columns: {len(strong)}",
                            f"Skewness above 3: {_named(strong)}.", [c for c, _ in strong],
                            "Use a power or log transform, or scale robustly."))
    if some:
        out.append(_warning(dataset_id, 2, "feature_skewness", "medium", f"Skewed columns: {len(some)}",
                            f"Skewness above 2: {_named(some)}.", [c for c, _ in some], "A transform may help linear models."))
    return out


def _dominance(figures, dataset_id):
    """Scaled variances are n/(n-1) or 0, so a column stands out exactly when it is
    one of at most three varying columns among more than three times as many."""
    p = len(figures)
    varying = [f["column"] for f in figures if f["min_filled"] is not None and f["min_filled"] != f["max_filled"]]
    if p >= 3 and 1 <= len(varying) <= 3 and p > 3 * len(varying):
        return [_warning(dataset_id, 3, "feature_dominance", "medium", "A few columns dominate",
                         f"Nearly all variation sits in {', '.join(varying)}.", varying, "Scale the columns to one range.")]
    return []


def _outliers(figures, dataset_id):
    hit = [(f["column"], rounded_value(f["outlier_pct"], 1)) for f in figures if f["outlier_pct"] is not None and f["outlier_pct"] > 10]
    if not hit:
        return []
    return [_warning(dataset_id, 4, "outlier_heavy", "medium" if len(hit) <= 3 else "high", f"Columns with many outliers: {len(hit)}",
                     f"Share beyond 1.5 interquartile ranges: {_named(hit, '%')}.", [c for c, _ in hit],
                     "Filter or cap the tails; trees are less affected.")]


def _low_variance(figures, dataset_id):
    hit = [(f["column"], rounded_value(f["same_pct"], 1)) for f in figures if f["same_pct"] is not None and f["same_pct"] > 95]
    if not hit:
        return []
    return [_warning(dataset_id, 5, "low_variance", "medium", f"Nearly constant columns: {len(hit)}",
                     f"One value fills almost the whole column: {_named(hit, '%')}.", [c for c, _ in hit], "Drop them.")]


def proxy_columns(columns: DataFrame) -> DataFrame:
    """Rows of a (…, name) table whose name hints at a protected attribute."""
    plain = F.regexp_replace(F.lower("name"), "[_-]", "")
    hit = reduce(lambda a, b: a | b, [F.contains(plain, F.lit(part)) for part in SENSITIVE_PARTS])
    return columns.where(hit)


def _proxy(df, dataset_id):
    names = local_table(df.sparkSession, [{"name": c, "position": i} for i, c in enumerate(df.columns)], "name string, position int")
    hit = [r["name"] for r in sorted(proxy_columns(names).collect(), key=lambda r: r["position"])]
    if not hit:
        return []
    return [_warning(dataset_id, 6, "proxy_variable", "medium", f"Possibly sensitive columns: {len(hit)}",
                     f"Names that hint at protected attributes: {', '.join(hit)}.", hit,
                     "Check whether a model may use them.")]


def _as_table(df: DataFrame, rows: list[dict]) -> DataFrame:
    return local_table(df.sparkSession, rows, WARNINGS)


def skewness(df: DataFrame, dataset_id: str = "table") -> DataFrame:
    return _as_table(df, _skewness(numeric_figures(df), dataset_id))


def dominance(df: DataFrame, dataset_id: str = "table") -> DataFrame:
    df = fold_nan(df)
    stats = column_stats(df, None, ("min_filled", "max_filled"), [])
    rows = [{"column": c, **v} for c, v in stats.values.items()]
    return _as_table(df, _dominance(rows, dataset_id))


def outliers(df: DataFrame, dataset_id: str = "table") -> DataFrame:
    return _as_table(df, _outliers(numeric_figures(df), dataset_id))


def low_variance(df: DataFrame, dataset_id: str = "table") -> DataFrame:
    return _as_table(df, _low_variance(numeric_figures(df), dataset_id))


def proxy(df: DataFrame, dataset_id: str = "table") -> DataFrame:
    return _as_table(df, _proxy(df, dataset_id))


def bias_warnings(df: DataFrame, dataset_id: str, target: str | None = None, figures: list[dict] | None = None) -> DataFrame:
    """All warnings of a table, in check order."""
    figures = numeric_figures(df) if figures is None else figures
    rows = [w for check in (_skewness, _dominance, _outliers, _low_variance) for w in check(figures, dataset_id)]
    rows += _proxy(df, dataset_id)
    out = _as_table(df, rows)
    if target is not None and target in df.columns:
        out = class_imbalance(df, target, dataset_id).unionByName(out)
    return out


def bias_sorted(warnings: DataFrame) -> DataFrame:
    """Most severe first, check order within a severity."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return warnings.withColumn("severity_rank", rank).orderBy("dataset_id", "severity_rank", "ord")
