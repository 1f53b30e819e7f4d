"""Rule-based insights: one filtered select per rule over the profile tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio, rounded
from ..functions.text import fixed
from ..operators.profile import Profile

_SEVERITY = ["info", "warning", "critical"]


def _row(df: DataFrame, ord_: Column | int, rule: Column | str, title: Column | str, text: Column, why: str, action: str,
         severity: Column | str, category: str, columns: Column | None = None) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        "dataset_id", lit(ord_).cast("int").alias("ord"), lit(rule).alias("rule"), lit(title).alias("title"),
        text.alias("description"), F.lit(why).alias("why"), F.lit(action).alias("action"),
        lit(severity).alias("severity"), F.lit(category).alias("category"),
        (columns if columns is not None else F.array().cast("array<string>")).alias("evidence"))


def _listed(df: DataFrame, order: str = "position", item: str = "name") -> DataFrame:
    """One row per table with the names in order and their number."""
    names = F.transform(F.array_sort(F.collect_list(F.struct(order, item))), lambda s: s[item])
    return df.groupBy("dataset_id").agg(names.alias("names"), F.count("*").alias("n"))


def _first(n: int = 5) -> Column:
    return F.array_join(F.slice("names", 1, n), ", ")


def missing_tier(p: Profile) -> DataFrame:
    m = F.col("missing_pct")
    severity = F.when(m <= 2, "info").when(m <= 10, "warning").otherwise("critical")
    title = (F.when(m == 0, "Nothing is missing").when(m <= 2, "Few missing values")
             .when(m <= 10, "Some missing values").otherwise("Many missing values"))
    return _row(p.metrics, 1, "missing_tier", title, F.concat(fixed(m, 2), F.lit("% of all cells are empty.")),
                "Empty cells must be filled or dropped before most models can use the table.",
                "Fill with a median or mode when few, with neighbours or chained regressions when many.",
                severity, "missing")


def _null_share(p: Profile) -> DataFrame:
    return (p.columns.join(p.metrics.select("dataset_id", "rows"), "dataset_id")
            .where((F.col("null_count") > 0) & (F.col("rows") > 0))
            .withColumn("pct", rounded(F.col("null_count") * 100.0 / F.col("rows").cast("double"), 1)))


def missing_column(p: Profile) -> DataFrame:
    hit = _null_share(p).where((F.col("pct") > 10) & (F.col("pct") <= 30))
    return _row(hit, F.lit(100) + F.col("position"), "missing_column",
                F.concat(F.lit("Gaps in "), F.col("name")),
                F.concat(F.col("name"), F.lit(" is empty in "), fixed(F.col("pct"), 1), F.lit("% of the rows.")),
                "A gap matters most when the column carries signal for the target.",
                "Fill this column on its own, or from similar rows.", "warning", "missing", F.array("name"))


def missing_columns_critical(p: Profile) -> DataFrame:
    hit = _listed(_null_share(p).where(F.col("pct") > 30))
    return _row(hit, 100_000, "missing_columns_critical", F.concat(F.lit("Mostly empty columns: "), F.col("n").cast("string")),
                F.concat(F.lit("More than 30% empty: "), _first(), F.lit(".")),
                "So little is left in these columns that filling them mostly adds noise.",
                "Drop those above half; treat the rest as unreliable.", "critical", "missing", F.col("names"))


def duplicate_tier(p: Profile) -> DataFrame:
    d = F.col("duplicate_pct")
    severity = F.when(d <= 1, "info").when(d <= 5, "warning").otherwise("critical")
    title = (F.when(d == 0, "Every row is unique").when(d <= 1, "Hardly any repeated rows")
             .when(d <= 5, "Some repeated rows").otherwise("Many repeated rows"))
    return _row(p.metrics, 200_000, "duplicate_tier", title, F.concat(fixed(d, 2), F.lit("% of the rows repeat another.")),
                "Copies that land on both sides of a split make a model look better than it is.",
                "Remove copies before splitting the table.", severity, "duplicates")


def size_tier(p: Profile) -> DataFrame:
    n = F.col("rows")
    title = (F.when(n < 100, "Very few rows").when(n < 1000, "A modest number of rows")
             .when(n < 10_000, "A fair number of rows").otherwise("Plenty of rows"))
    return _row(p.metrics, 300_000, "size_tier", title,
                F.concat(n.cast("string"), F.lit(" rows and "), F.col("columns").cast("string"), F.lit(" columns.")),
                "The number of rows limits how complex a model can be.",
                "Prefer simple models and cross-validation when rows are few.",
                F.when(n < 100, "warning").otherwise("info"), "size")


def _card(p: Profile) -> DataFrame:
    u, number = F.col("unique_count"), F.col("type") == "number"
    kind = (F.when(u == 1, "constant_columns").when((u == 2) & (F.col("type") != "boolean"), "binary_columns")
            .when(number & (u <= 5), "low_card_numeric"))
    return p.columns.withColumn("kind", kind)


def constant_columns(p: Profile) -> DataFrame:
    hit = _listed(_card(p).where(F.col("kind") == "constant_columns"))
    return _row(hit, 400_000, "constant_columns", F.concat(F.lit("Constant columns: "), F.col("n").cast("string")),
                F.concat(F.lit("Always the same value: "), _first(), F.lit(".")),
                "A column that never changes tells a model nothing.", "Drop it.", "critical", "column", F.col("names"))


def binary_columns(p: Profile) -> DataFrame:
    hit = _listed(_card(p).where(F.col("kind") == "binary_columns"))
    return _row(hit, 400_001, "binary_columns", F.concat(F.lit("Two-valued columns: "), F.col("n").cast("string")),
                F.concat(F.lit("Exactly two values: "), _first(), F.lit(".")),
                "Two-valued columns are often flags or targets.", "Encode them as 0 and 1.", "info", "column", F.col("names"))


def low_card_numeric(p: Profile) -> DataFrame:
    hit = _listed(_card(p).where(F.col("kind") == "low_card_numeric"))
    return _row(hit, 400_002, "low_card_numeric", F.concat(F.lit("Numbers with few values: "), F.col("n").cast("string")),
                F.concat(F.lit("At most five values: "), _first(), F.lit(".")),
                "Such numbers are often codes rather than measurements.", "Consider treating them as categories.",
                "info", "column", F.col("names"))


def id_like_columns(p: Profile) -> DataFrame:
    share = ratio(F.col("unique_count"), F.col("rows"))
    hit = _listed(p.columns.join(p.metrics.select("dataset_id", "rows"), "dataset_id")
                  .where((F.col("type") == "string") & (share > 0.9)))
    return _row(hit, 400_003, "id_like_columns", F.concat(F.lit("Identifier-like columns: "), F.col("n").cast("string")),
                F.concat(F.lit("Nearly every value is different: "), _first(), F.lit(".")),
                "Identifiers do not generalise and explode when encoded.", "Keep them out of the model.",
                "warning", "column", F.col("names"))


def correlation_tiers(p: Profile) -> DataFrame:
    size = F.abs("value")
    tier = F.when(size >= 0.9, 0).when(size >= 0.7, 1).when(size >= 0.5, 2)
    named = p.correlations.withColumn("tier", tier).where(F.col("tier").isNotNull()).withColumn(
        "pair", F.concat("column1", F.lit(" / "), "column2"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "pair"))), lambda s: s["pair"])
    hit = named.groupBy("dataset_id", "tier").agg(pairs.alias("names"), F.count("*").alias("n"))
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), F.col("tier") + 1)
    return _row(hit, F.lit(500_000) + F.col("tier"), pick("corr_very_strong", "corr_strong", "corr_moderate"),
                F.concat(pick("Nearly identical pairs: ", "Strongly related pairs: ", "Moderately related pairs: "),
                         F.col("n").cast("string")),
                F.concat(_first(3), F.lit(".")),
                "Columns that move together repeat the same information.",
                "Keep one of each near-identical pair; leave moderate ones to the model.",
                pick("critical", "warning", "info"), "correlation", F.col("names"))


def skewed_distributions(p: Profile) -> DataFrame:
    uneven = (
        p.distributions.groupBy("dataset_id", "column", "kind")
        .agg(F.count("*").alias("bins"), F.min("count").alias("least"), F.max("count").alias("most"))
        .where((F.col("bins") >= 2) & (F.col("most") > 0) & (F.col("least") / F.col("most").cast("double") < 0.1))
    )
    hit = _listed(uneven.select("dataset_id", F.col("column").alias("name"), F.col("column").alias("position")))
    return _row(hit, 600_000, "skewed_distributions", F.concat(F.lit("Uneven distributions: "), F.col("n").cast("string")),
                F.concat(F.lit("Rarest bin below a tenth of the fullest: "), _first(), F.lit(".")),
                "Long tails pull linear and distance-based models.", "Try a power or log transform.",
                "warning", "distribution", F.col("names"))


def feature_diversity(p: Profile) -> DataFrame:
    kinds = p.columns.groupBy("dataset_id").agg(*[F.count(F.when(F.col("type") == k, True)).alias(k)
                                                  for k in ("number", "string", "date")])
    hit = kinds.where(F.col("string") > 0)
    mixed = F.col("number") > 0
    return _row(hit, 700_000, "feature_diversity",
                F.when(mixed, "Numbers and categories together").otherwise("Only text columns"),
                F.concat(F.col("number").cast("string"), F.lit(" numeric, "), F.col("string").cast("string"),
                         F.lit(" text and "), F.col("date").cast("string"), F.lit(" date columns.")),
                "A mix of types supports richer models; text alone must be encoded first.",
                "Encode categories by their number of values.",
                F.when(mixed, "info").otherwise("warning"), "column")


RULES = [missing_tier, missing_column, missing_columns_critical, duplicate_tier, size_tier, constant_columns,
         binary_columns, low_card_numeric, id_like_columns, correlation_tiers, skewed_distributions, feature_diversity]


def insights(p: Profile) -> DataFrame:
    """All insights; ``ord`` sorts them within a table."""
    return reduce(DataFrame.unionByName, [rule(p) for rule in RULES])
