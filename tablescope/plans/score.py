"""Quality score 0-100 from the profile tables, one row per table and component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..functions.text import fixed
from ..operators.profile import Profile
from .rules import COMPLETENESS_LABELS, COMPLETENESS_POINTS, UNIQUENESS_LABELS, UNIQUENESS_POINTS


def ladder(value: Column, steps: list[tuple]) -> Column:
    """First step whose upper bound holds ``value``; the last step is the rest."""
    out = F.lit(steps[-1][1])
    for bound, result in reversed(steps[:-1]):
        out = F.when(value <= bound, F.lit(result)).otherwise(out)
    return out


def _facts(p: Profile) -> DataFrame:
    kinds = p.columns.groupBy("dataset_id").agg(
        F.count_distinct("type").alias("kinds"),
        F.count(F.when(F.col("type") == "number", True)).alias("numbers"),
        F.count(F.when(F.col("type") == "string", True)).alias("strings"),
    )
    return p.metrics.join(kinds, "dataset_id", "left").na.fill(0, ["kinds", "numbers", "strings"])


def quality_score(p: Profile) -> DataFrame:
    """(dataset_id, name, score, max_score, label, description) for four components."""
    rows, cols = F.col("rows"), F.col("columns")
    missing, dup = F.col("missing_pct"), F.col("duplicate_pct")
    numbers, strings, kinds = F.col("numbers"), F.col("strings"), F.col("kinds")

    size_points = (F.when((rows >= 1000) & (cols >= 3), 25.0).when((rows >= 500) & (cols >= 2), 20.0)
                   .when(rows >= 100, 15.0).when(rows >= 50, 10.0).otherwise(5.0))
    size_label = (F.when(rows < 100, "Poor").when(rows >= 10_000, "Excellent")
                  .when(rows >= 1000, "Good").otherwise("Fair"))
    some = (numbers > 0) | (strings > 0)
    mix_points = (F.when(kinds == 0, 12.0).when((kinds >= 3) & (numbers > 0) & (strings > 0), 25.0)
                  .when(kinds >= 2, 20.0).when(some, 15.0).otherwise(10.0))
    mix_label = (F.when(kinds == 0, "Unknown").when((kinds >= 3) & (numbers > 0) & (strings > 0), "Excellent")
                 .when(kinds >= 2, "Good").when(some, "Fair").otherwise("Poor"))

    def part(name, points, most, label, text):
        return F.struct(F.lit(name).alias("name"), points.alias("score"), F.lit(most).alias("max_score"),
                        label.alias("label"), text.alias("description"))

    parts = F.array(
        part("completeness", ladder(missing, COMPLETENESS_POINTS), 30.0, ladder(missing, COMPLETENESS_LABELS),
             F.concat(fixed(missing, 1), F.lit("% of the cells are empty"))),
        part("uniqueness", ladder(dup, UNIQUENESS_POINTS), 20.0, ladder(dup, UNIQUENESS_LABELS),
             F.concat(fixed(dup, 1), F.lit("% of the rows repeat an earlier row"))),
        part("size", size_points, 25.0, size_label,
             F.concat(rows.cast("string"), F.lit(" rows by "), cols.cast("string"), F.lit(" columns"))),
        part("diversity", mix_points, 25.0, mix_label,
             F.concat(kinds.cast("string"), F.lit(" column types, "), numbers.cast("string"), F.lit(" numeric and "),
                      strings.cast("string"), F.lit(" text columns"))),
    )
    return _facts(p).select("dataset_id", F.explode(parts).alias("part")).select("dataset_id", "part.*")


def quality_label(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def overall_score(p: Profile) -> DataFrame:
    """(dataset_id, score, quality, explanation)."""
    order = F.array(F.lit("completeness"), F.lit("uniqueness"), F.lit("size"), F.lit("diversity"))
    said = F.array_sort(F.collect_list(F.struct(F.array_position(order, F.col("name")).alias("at"),
                                                F.concat_ws(": ", "label", "description").alias("text"))))
    total = quality_score(p).groupBy("dataset_id").agg(
        rounded(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.sum("score"))), 1).alias("score"), said.alias("said"))
    return total.select(
        "dataset_id", "score", quality_label(F.col("score")).alias("quality"),
        F.concat(F.array_join(F.transform("said", lambda s: s["text"]), "; "), F.lit(". Score "),
                 fixed(F.col("score"), 1), F.lit(" of 100.")).alias("explanation"))
