"""Ordered next steps from the judgements of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..operators.profile import Profile


def next_steps(p: Profile, insights: DataFrame, bias: DataFrame, recommendation: DataFrame) -> DataFrame:
    """(dataset_id, ord, title, description, action_type, action_key, is_critical).

    Each judgement table is reduced to one row of flags per table, the flags are
    joined, and the steps that apply come out of one array in rule order.
    """
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    col_flags = p.columns.groupBy("dataset_id").agg(
        F.count(F.when(F.col("unique_count") <= 1, True)).alias("constants"),
        F.count(F.when(F.col("type") == "number", True)).alias("numbers"),
        F.count(F.when(F.col("type") == "string", True)).alias("strings"))
    seen = insights.groupBy("dataset_id").agg(
        has((F.col("category") == "correlation") & (F.col("severity") == "critical")).alias("twins"),
        has((F.col("category") == "distribution") & F.col("severity").isin("warning", "critical")).alias("skewed"))
    warned = bias.groupBy("dataset_id").agg(
        has(F.col("type") == "class_imbalance").alias("imbalanced"),
        has((F.col("type") == "class_imbalance") & (F.col("severity") == "high")).alias("imbalance_high"),
        has(F.col("type") == "outlier_heavy").alias("outliers"))
    advice = recommendation.select("dataset_id", "task", "models", "target")
    facts = (p.metrics.join(col_flags, "dataset_id", "left").join(seen, "dataset_id", "left")
             .join(warned, "dataset_id", "left").join(advice, "dataset_id", "left"))

    missing, dup = F.col("missing_pct"), F.col("duplicate_pct")
    no, yes = F.lit(False), F.lit(True)
    flag = lambda name: F.coalesce(F.col(name), no)
    pct = lambda c: F.concat(fixed(c, 2), F.lit("%"))

    def step(when, title, text, kind, key=None, critical=no):
        as_col = lambda v: v if not isinstance(v, str) else F.lit(v)
        body = F.struct(as_col(title).alias("title"), as_col(text).alias("description"), F.lit(kind).alias("action_type"),
                        F.lit(key).cast("string").alias("action_key"), critical.alias("is_critical"))
        return F.when(when, body)

    steps = F.array_compact(F.array(
        step(missing > 5, "Fill the missing values", F.concat(pct(missing), F.lit(" of the cells are empty; use neighbours or chained regressions.")),
             "preprocess", "handle_missing", missing > 15),
        step((missing > 0) & (missing <= 5), "Fill the few missing values",
             F.concat(pct(missing), F.lit(" of the cells are empty; a median or mode is enough.")), "preprocess", "handle_missing"),
        step(dup > 2, "Remove repeated rows", F.concat(pct(dup), F.lit(" of the rows are copies that could leak across a split.")),
             "preprocess", "remove_duplicates", dup > 10),
        step(F.coalesce(F.col("constants"), F.lit(0)) > 0, "Drop constant columns",
             F.concat(F.col("constants").cast("string"), F.lit(" column(s) never change.")), "preprocess", "drop_low_variance"),
        step(flag("twins"), "Drop near-identical columns", "Some pairs of columns carry the same information.",
             "preprocess", "remove_correlated"),
        step(flag("skewed"), "Even out skewed columns", "A power transform shortens the long tails.", "preprocess", "handle_skewness"),
        step(flag("imbalanced"), "Balance the classes", "One class outweighs the others; oversample or weight the rest.",
             "info", None, flag("imbalance_high")),
        step(flag("outliers"), "Deal with outliers", "Filter by the interquartile range or scale robustly.", "preprocess", "remove_outliers"),
        step(F.coalesce(F.col("numbers"), F.lit(0)) >= 2, "Scale the numbers",
             F.concat(F.lit("Bring "), F.col("numbers").cast("string"), F.lit(" numeric columns to one scale.")), "preprocess", "normalize"),
        step(F.coalesce(F.col("strings"), F.lit(0)) > 0, "Encode the categories",
             F.concat(F.lit("Turn "), F.col("strings").cast("string"), F.lit(" text columns into numbers.")), "preprocess", "encode_categorical"),
        step(yes, "Split off a test set", "Keep 20% aside; stratify when classifying.", "model"),
        step(F.coalesce(F.col("task"), F.lit("")) != "",
             F.concat(F.lit("Train: "), F.translate("task", "-", " ")),
             F.concat(F.lit("Start with "), F.array_join(F.slice("models", 1, 3), ", "),
                      F.coalesce(F.concat(F.lit("; target "), F.col("target")), F.lit("")), F.lit(".")), "model"),
        step(yes, "Evaluate", "Cross-validate with a metric that fits the task.", "info"),
    ))
    out = facts.select("dataset_id", F.posexplode(steps).alias("at", "s"))
    return out.select("dataset_id", (F.col("at") + 1).alias("ord"), "s.*")
