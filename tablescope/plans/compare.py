"""Compare profiled tables pair by pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio, rounded
from ..functions.text import fixed
from ..operators.profile import Profile
from .score import overall_score


def dataset_summary(p: Profile, recommendation: DataFrame | None = None) -> DataFrame:
    """One row per table with the figures used in a comparison."""
    kinds = p.columns.groupBy("dataset_id").agg(
        F.count(F.when(F.col("type") == "number", True)).alias("numbers"),
        F.count(F.when(F.col("type") == "string", True)).alias("strings"),
        rounded(ratio(F.sum("null_count"), F.count("*")), 1).alias("avg_nulls"))
    strongest = p.correlations.groupBy("dataset_id").agg(F.max(F.abs("value")).alias("top"))
    strength = (F.when(F.col("top") >= 0.9, "strong").when(F.col("top") >= 0.7, "moderate")
                .when(F.col("top") >= 0.4, "weak").otherwise("none"))
    score = overall_score(p).select("dataset_id", "score", "quality")
    out = (p.metrics.join(score, "dataset_id").join(kinds, "dataset_id", "left").join(strongest, "dataset_id", "left")
           .withColumn("correlation_strength", strength).drop("top"))
    if recommendation is None:
        return out.withColumn("task", F.lit("")).withColumn("target", F.lit(None).cast("string"))
    return out.join(recommendation.select("dataset_id", "task", "target"), "dataset_id", "left")


def _balance(side: str) -> Column:
    few = F.least(F.col(side + "_numbers"), F.col(side + "_strings"))
    many = F.greatest(F.col(side + "_numbers"), F.col(side + "_strings"))
    return F.coalesce(ratio(few, many), F.lit(0.0))


def compare(summary: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b, metric, value_a, value_b, winner, weight, explanation).

    ``pairs`` (id_a, id_b) names the comparisons, so the work grows with what is
    asked for. The joins run over table summaries, never over table rows.
    """
    a = summary.select([F.col(c).alias("a_" + c) for c in summary.columns])
    b = summary.select([F.col(c).alias("b_" + c) for c in summary.columns])
    both = (pairs.select("id_a", "id_b").distinct()
            .join(a, F.col("id_a") == F.col("a_dataset_id")).join(b, F.col("id_b") == F.col("b_dataset_id")))
    A, B = (lambda c: F.col("a_" + c)), (lambda c: F.col("b_" + c))
    text = lambda c: c.cast("string")
    pct = lambda c: F.concat(fixed(c, 2), F.lit("%"))
    mix = lambda s: F.concat(text(F.col(s + "_numbers")), F.lit(" numeric, "), text(F.col(s + "_strings")), F.lit(" text"))
    never = F.lit(False)

    def metric(name, a_wins, b_wins, value_a, value_b, weight, why):
        winner = F.when(a_wins, A("dataset_id")).when(b_wins, B("dataset_id")).otherwise(F.lit("tie"))
        return F.struct(F.lit(name).alias("metric"), value_a.alias("value_a"), value_b.alias("value_b"),
                        winner.alias("winner"), F.lit(weight).alias("weight"), F.lit(why).alias("explanation"))

    metrics = F.array(
        metric("rows", A("rows") > B("rows") * 1.1, B("rows") > A("rows") * 1.1, text(A("rows")), text(B("rows")), 1,
               "More rows to learn from."),
        metric("columns", A("columns") > B("columns"), B("columns") > A("columns"), text(A("columns")), text(B("columns")), 1,
               "More possible features."),
        metric("missing", A("missing_pct") < B("missing_pct") - 0.5, B("missing_pct") < A("missing_pct") - 0.5,
               pct(A("missing_pct")), pct(B("missing_pct")), 2, "Fewer gaps to fill."),
        metric("duplicates", A("duplicate_pct") < B("duplicate_pct") - 0.5, B("duplicate_pct") < A("duplicate_pct") - 0.5,
               pct(A("duplicate_pct")), pct(B("duplicate_pct")), 1, "Fewer repeated rows."),
        metric("quality", A("score") > B("score") + 3, B("score") > A("score") + 3, fixed(A("score"), 1), fixed(B("score"), 1), 2,
               "Higher overall quality."),
        metric("balance", _balance("a") > _balance("b"), _balance("b") > _balance("a"), mix("a"), mix("b"), 1,
               "A more even mix of numeric and text columns."),
        metric("task", never, never, F.coalesce(F.nullif(A("task"), F.lit("")), F.lit("unknown")),
               F.coalesce(F.nullif(B("task"), F.lit("")), F.lit("unknown")), 0, "For information."),
    )
    return both.select(F.col("a_dataset_id").alias("id_a"), F.col("b_dataset_id").alias("id_b"),
                       F.explode(metrics).alias("m")).select("id_a", "id_b", "m.*")


def compare_winner(compared: DataFrame, summary: DataFrame) -> DataFrame:
    """(id_a, id_b, points_a, points_b, best, explanation), one row per pair."""
    side = lambda who: F.sum(F.when(F.col("winner") == F.col(who), F.col("weight")).otherwise(0))
    points = compared.groupBy("id_a", "id_b").agg(side("id_a").alias("points_a"), side("id_b").alias("points_b"))
    facts = ["score", "rows", "missing_pct", "duplicate_pct"]
    for s in ("a", "b"):
        cols = [F.col("dataset_id").alias("id_" + s)] + [F.col(c).alias(f"{s}_{c}") for c in facts]
        points = points.join(summary.select(*cols), "id_" + s)
    a_best = (F.when(F.col("points_a") != F.col("points_b"), F.col("points_a") > F.col("points_b"))
              .otherwise(F.col("a_score") >= F.col("b_score")))
    out = points.withColumn("a_best", a_best)
    win = lambda c: F.when(F.col("a_best"), F.col("a_" + c)).otherwise(F.col("b_" + c))
    lose = lambda c: F.when(F.col("a_best"), F.col("b_" + c)).otherwise(F.col("a_" + c))
    reasons = F.slice(F.array_compact(F.array(
        F.when(win("score") > lose("score"), F.lit("a higher score")),
        F.when(win("rows") > lose("rows"), F.lit("more rows")),
        F.when(win("missing_pct") < lose("missing_pct"), F.lit("fewer gaps")),
        F.when(win("duplicate_pct") < lose("duplicate_pct"), F.lit("fewer copies")))), 1, 3)
    best = F.when(F.col("a_best"), F.col("id_a")).otherwise(F.col("id_b"))
    text = (F.when(F.col("points_a") == F.col("points_b"), F.lit("Both are close; choose by the task at hand."))
            .otherwise(F.concat(best, F.lit(" has "), F.when(F.size(reasons) > 0, F.array_join(reasons, ", "))
                                .otherwise(F.lit("slightly better figures")), F.lit("."))))
    return out.select("id_a", "id_b", F.col("points_a").cast("bigint").alias("points_a"),
                      F.col("points_b").cast("bigint").alias("points_b"), best.alias("best"), text.alias("explanation"))
