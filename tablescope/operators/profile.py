"""Profiling: types, shape, missing values, duplicates, correlations, distributions."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import (fold_nan, is_nested, is_numeric, is_text, numeric_columns, quoted, rounded,
                                 rounded_value, text_columns)
from ..functions.text import format_number, json_safe, truncate_label
from ..session import in_parallel, local_table
from .correlations import correlations
from .histograms import Bins, histogram_counts, log_bins, top_values
from .stats import ColumnStats, column_stats
from .value_counts import counted, distinct_counts, families

METRICS = "dataset_id string, rows bigint, columns int, missing_pct double, duplicate_pct double"
COLUMNS = "dataset_id string, position int, name string, type string, null_count bigint, unique_count bigint"
CORRELATIONS = "dataset_id string, rank int, column1 string, column2 string, value double"
DISTRIBUTIONS = ("dataset_id string, column string, kind string, bin int, label string, "
                 "lo double, hi double, count bigint")

# Text layouts read as dates besides the ISO forms.
DATE_FORMATS = ["M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "d.M.yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy",
                "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy/M/d H:mm:ss", "yyyyMMdd"]


class EmptyTableError(ValueError):
    """Nothing is left once empty columns and rows are gone."""


@dataclass
class Profile:
    """The small result tables of one or many profiled tables."""

    metrics: DataFrame
    columns: DataFrame
    correlations: DataFrame
    distributions: DataFrame
    warnings: list[str] = field(default_factory=list)

    def union(self, other: "Profile") -> "Profile":
        parts = {f.name: getattr(self, f.name).unionByName(getattr(other, f.name))
                 for f in fields(self) if f.name != "warnings"}
        return Profile(**parts, warnings=self.warnings + other.warnings)


def drop_empty(df: DataFrame, stats: ColumnStats | None = None) -> DataFrame:
    """Drop columns without any value, then rows without any value."""
    df = fold_nan(df)
    stats = stats or column_stats(df, [], ())
    kept = [c for c in df.columns if stats.count[c] > 0]
    if not kept:
        raise EmptyTableError("no usable data: every cell is empty")
    return df.select([quoted(c) for c in kept]).na.drop("all")


def table_shape(df: DataFrame) -> DataFrame:
    kept = drop_empty(df)
    return kept.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(kept.columns)))


def missing_pct(df: DataFrame) -> DataFrame:
    """Share of null cells in percent, 2 decimals."""
    df = drop_empty(df)
    filled = sum((F.count(quoted(c)) for c in df.columns), F.lit(0))
    cells = F.count("*") * len(df.columns)
    return df.agg(rounded(F.try_divide((cells - filled) * 100.0, cells), 2).alias("missing_pct"))


def duplicate_groups(df: DataFrame, with_nulls: list[str] | None = None) -> DataFrame:
    """(copies) per distinct row, null equal to null.

    Rows are compared by two independent 64-bit hashes plus the pattern of
    nulls, so the shuffle moves a few bytes per row instead of whole rows and
    copies are combined before it. At 10^12 distinct rows the chance of one
    false match is below 10^-14. ``with_nulls`` names the columns that have nulls,
    when that is known.
    """
    values = [F.to_json(quoted(f.name)) if is_nested(f) else quoted(f.name) for f in df.schema.fields]
    gappy = df.columns if with_nulls is None else with_nulls
    nulls = [F.when(quoted(c).isNull(), F.lit(1)).otherwise(F.lit(0)) for c in gappy]
    words = []
    for start in range(0, len(nulls), 31):
        words.append(sum((n * (1 << k) for k, n in enumerate(nulls[start:start + 31])), F.lit(0)))
    return (
        df.select(F.xxhash64(*words, *values).alias("h1"), F.xxhash64(F.lit("second"), *values, *words).alias("h2"))
        .groupBy("h1", "h2").agg(F.count("*").alias("copies"))
    )


def duplicate_pct(df: DataFrame, with_nulls: list[str] | None = None) -> DataFrame:
    """Rows equal to an earlier row, in percent of all rows, 2 decimals."""
    rows = F.sum("copies")
    return duplicate_groups(df, with_nulls).agg(
        rounded(F.coalesce(F.try_divide((rows - F.count("*")) * 100.0, rows), F.lit(0.0)), 2).alias("duplicate_pct"))


def maybe_date(value):
    """Whether text can read as a date or time at all: all known layouts have a digit at the start, after a sign, or
    after the name of a month. Spares most texts the parsers, which are slow on what they refuse."""
    return value.rlike(r"^[\x00-\x20\x7F]*[^0-9]{0,12}[0-9]")


def looks_like_date(value, formats: list[str] | None = None):
    """True for text that reads as a date or time in any known layout."""
    tests = [value.try_cast("timestamp").isNotNull()]
    tests += [F.try_to_timestamp(value, F.lit(f)).isNotNull() for f in (DATE_FORMATS if formats is None else formats)]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(maybe_date(value), F.lit(False)) & out if formats is None else out


def _simple_type(f: T.StructField) -> str | None:
    if isinstance(f.dataType, T.BooleanType):
        return "boolean"
    if is_numeric(f):
        return "number"
    if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if is_nested(f):
        return "object"
    return None     # text: depends on the values


def _types_and_uniques(df: DataFrame, approx: bool, formats: list[str] | None, digest: bool) -> DataFrame:
    """(column, unique_count, all_dates) - dates are tested on distinct values only, on all where texts are counted by digest."""
    text = text_columns(df)
    other = [c for c in df.columns if c not in text]
    parts = []
    if other:
        parts.append(distinct_counts(df, other, approx).withColumn("all_dates", F.lit(False)))
    if text:
        [(_, long)] = families(df, text)
        dated, dated_key = looks_like_date(F.col("value"), formats), looks_like_date(F.col("key"), formats)
        if approx:
            parts.append(long.groupBy("column").agg(F.approx_count_distinct("value").alias("unique_count"),
                                                    F.bool_and(dated).alias("all_dates")))
        else:
            keys = long.groupBy("column", counted(F.col("value"), "string", digest).alias("key"))
            keys = keys.agg(F.bool_and(dated).alias("dated")) if digest else keys.agg(F.lit(1)).select("column", dated_key.alias("dated"))
            parts.append(keys.groupBy("column").agg(F.count("*").alias("unique_count"), F.bool_and("dated").alias("all_dates")))
    return reduce(DataFrame.unionByName, parts)


def _column_rows(df: DataFrame, approx: bool, formats: list[str] | None, stats: ColumnStats, digest: bool = False) -> list[dict]:
    found = {r["column"]: r for r in _types_and_uniques(df, approx, formats, digest).collect()}   # one row per column
    rows = []
    for i, f in enumerate(df.schema.fields):
        got = found.get(f.name)
        kind = _simple_type(f) or ("date" if got and got["all_dates"] else "string")
        rows.append({"position": i, "name": f.name, "type": kind,
                     "null_count": stats.rows - stats.count[f.name],
                     "unique_count": got["unique_count"] if got else 0})
    return rows


def column_types(df: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """(name, type). All values of a text column must read as dates for ``date``."""
    rows = _column_rows(df, False, formats, column_stats(df, [], ()))
    return local_table(df.sparkSession, [{"name": r["name"], "type": r["type"]} for r in rows],
                       "name string, type string")


def column_profile(df: DataFrame, approx: bool = False, digest: bool = False) -> DataFrame:
    """(position, name, type, null_count, unique_count). Texts are told apart by themselves, with ``digest`` by their SHA-256."""
    df = fold_nan(df)
    rows = _column_rows(df, approx, None, column_stats(df, [], ()), digest)
    return local_table(df.sparkSession, rows, COLUMNS.split(", ", 1)[1])


def variance_rank(df: DataFrame, keep: int = 8, stats: ColumnStats | None = None) -> list[str]:
    """The numeric columns to plot: all when few, else those of highest variance."""
    numeric = numeric_columns(df)
    if len(numeric) <= keep:
        return numeric
    stats = stats or column_stats(df, numeric, ("variance",))
    spread = lambda c: stats.get(c, "variance") if stats.get(c, "variance") is not None else float("-inf")
    return sorted(numeric, key=lambda c: -spread(c))[:keep]


def numeric_distributions(df: DataFrame, max_numeric: int = 8, stats: ColumnStats | None = None) -> DataFrame | None:
    numeric = numeric_columns(df)
    stats = stats or column_stats(df, numeric, ("min", "max", "variance"))
    bins = []
    for c in variance_rank(df, max_numeric, stats):
        n = stats.count[c]
        if n < 5:
            continue
        b = Bins(c, stats.get(c, "min"), stats.get(c, "max"), log_bins(n, 6, 10))
        if b.usable():
            bins.append(b)
    if not bins:
        return None
    out = histogram_counts(df, bins)
    label = F.concat(format_number(F.col("lo")), F.lit("–"), format_number(F.col("hi")))
    return out.select("column", F.lit("numeric").alias("kind"), "bin", label.alias("label"), "lo", "hi", "count")


def categorical_distributions(df: DataFrame, uniques: dict[str, int], max_categorical: int = 4) -> DataFrame | None:
    text = text_columns(df)
    chosen = [c for c in text if 2 <= uniques.get(c, 0) <= 50] or [c for c in text if 2 <= uniques.get(c, 0) <= 200]
    if not chosen[:max_categorical]:
        return None
    top = top_values(df, chosen[:max_categorical], 10)
    none = F.lit(None).cast("double")
    return top.select("column", F.lit("categorical").alias("kind"), "bin", truncate_label(F.col("value")).alias("label"),
                      none.alias("lo"), none.alias("hi"), "count")


def distributions(df: DataFrame, max_numeric: int = 8, max_categorical: int = 4) -> DataFrame:
    df = drop_empty(df)
    text = text_columns(df)
    uniques = {r["column"]: r["unique_count"] for r in distinct_counts(df, text).collect()} if text else {}
    parts = [p for p in (numeric_distributions(df, max_numeric),
                         categorical_distributions(df, uniques, max_categorical)) if p is not None]
    if not parts:
        return local_table(df.sparkSession, [], DISTRIBUTIONS.split(", ", 1)[1])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def profile(df: DataFrame, dataset_id: str, approx: bool = False, warnings: list[str] | None = None, digest: bool = False) -> Profile:
    """Profile one table into small tables keyed by ``dataset_id``.

    Five column-pruned scans whatever the number of columns: first counts and
    moments, then side by side row hashes, typed value counts, correlation sums
    and histogram bins. Only per-column results reach the driver; rows never do. With ``digest``
    texts are counted by their SHA-256, so that long ones are not shuffled.
    """
    spark = df.sparkSession
    df = fold_nan(df)
    numeric = numeric_columns(df)
    stats = column_stats(df, numeric, ("min", "max", "mean", "variance"))
    kept = [c for c in df.columns if stats.count[c] > 0]
    if not kept:
        raise EmptyTableError("no usable data: every cell is empty")
    full_column = any(stats.count[c] == stats.rows for c in kept)
    df = df.select([quoted(c) for c in kept])
    if not full_column:                     # otherwise no row can be all null
        df = df.na.drop("all")
        stats.rows = df.count()

    gappy = [c for c in kept if stats.count[c] < stats.rows]
    collected = lambda part: part.collect() if part is not None else []         # at most 8 x 10 + 4 x 11 rows

    def columns_and_categories():
        columns = _column_rows(df, approx, None, stats, digest)
        uniques = {r["name"]: r["unique_count"] for r in columns}
        return columns, collected(categorical_distributions(df, uniques))

    dup, pairs, bins, (columns, tops) = in_parallel(
        spark,
        lambda: duplicate_pct(df, gappy).first()[0],
        lambda: correlations(df, stats=stats).collect() if len(numeric_columns(df)) > 1 else [],
        lambda: collected(numeric_distributions(df, stats=stats)),
        columns_and_categories,
    )
    cells = stats.rows * len(kept)
    empty = sum(stats.rows - stats.count[c] for c in kept)
    metric = {"dataset_id": dataset_id, "rows": stats.rows, "columns": len(kept),
              "missing_pct": rounded_value(empty * 100.0 / cells, 2), "duplicate_pct": dup}
    bins += tops

    def keyed(rows):
        return [{"dataset_id": dataset_id, **(r if isinstance(r, dict) else r.asDict())} for r in rows]

    return Profile(
        local_table(spark, [metric], METRICS),
        local_table(spark, keyed(columns), COLUMNS),
        local_table(spark, keyed(pairs), CORRELATIONS),
        local_table(spark, keyed(bins), DISTRIBUTIONS),
        list(warnings or []),
    )


def profile_many(tables: dict[str, DataFrame], approx: bool = False) -> Profile:
    """Profile several tables into one set of result tables."""
    if not tables:
        raise ValueError("no tables given")
    items, done = list(tables.items()), []
    for i in range(0, len(items), 4):           # some tables side by side
        jobs = [lambda name=name, df=df: profile(df, name, approx) for name, df in items[i:i + 4]]
        done += in_parallel(items[0][1].sparkSession, *jobs)
    return reduce(Profile.union, done)


def preview(df: DataFrame, n: int = 20, order_by: list[str] | str | None = None) -> DataFrame:
    """First ``n`` rows by an explicit order, ready for JSON."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by or [])
    if keys:
        df = df.orderBy(*[quoted(k) for k in keys])
    return json_safe(df.limit(n))


def row_cap(df: DataFrame, max_rows: int, order_by: list[str] | str) -> tuple[DataFrame, list[str]]:
    """Keep the first ``max_rows`` rows by ``order_by`` and say so if any were cut."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    capped = df.orderBy(*[quoted(k) for k in keys]).limit(max_rows)
    over = df.limit(max_rows + 1).count() > max_rows
    return capped, [f"Only the first {max_rows:,} rows were kept."] if over else []


# ---- views over the profile tables -------------------------------------------------

def column_completeness(p: Profile) -> DataFrame:
    """Null share and its complement, per column, in percent."""
    share = F.coalesce(F.try_divide(F.col("null_count") * 100.0, F.col("rows").cast("double")), F.lit(0.0))
    return p.columns.join(p.metrics.select("dataset_id", "rows"), "dataset_id").select(
        "dataset_id", "position", "name", rounded(share, 4).alias("null_pct"),
        rounded(100.0 - share, 4).alias("completeness_pct"))


def missing_map(p: Profile) -> DataFrame:
    """Columns by missing share; nothing for a table without nulls."""
    pct = rounded(F.coalesce(F.try_divide(F.col("null_count") * 100.0, F.col("rows").cast("double")), F.lit(0.0)), 1)
    band = (F.when(F.col("pct") == 0, "none").when(F.col("pct") < 5, "minimal").when(F.col("pct") < 15, "low")
            .when(F.col("pct") < 30, "moderate").when(F.col("pct") < 50, "high").otherwise("severe"))
    w = Window.partitionBy("dataset_id")        # one row per column of the table
    return (
        p.columns.join(p.metrics.select("dataset_id", "rows"), "dataset_id")
        .withColumn("pct", pct).withColumn("nulls", F.sum("null_count").over(w))
        .where(F.col("nulls") > 0)
        .select("dataset_id", "name", "type", "null_count", "pct", band.alias("band"),
                F.row_number().over(w.orderBy(F.desc("pct"), "position")).alias("ord"))
        .orderBy("dataset_id", "ord")
    )


def distribution_summary(p: Profile) -> DataFrame:
    """Per distribution: total, number of bins, largest count and the first bin that has it."""
    top = F.max(F.struct(F.col("count"), (-F.col("bin")).alias("neg"), F.col("label")))
    return (
        p.distributions.groupBy("dataset_id", "column", "kind")
        .agg(F.sum("count").alias("total"), F.count("*").alias("bins"), top.alias("top"))
        .select("dataset_id", "column", "kind", "total", "bins", F.col("top.count").alias("max_count"),
                F.col("top.label").alias("modal_label"),
                rounded(F.try_divide(F.col("top.count") * 100.0, F.col("total").cast("double")), 1).alias("modal_share_pct"))
    )


def distribution_shares(p: Profile) -> DataFrame:
    """Each bin with its share of the distribution in percent."""
    w = Window.partitionBy("dataset_id", "column")      # at most 11 bins
    return p.distributions.select(
        "dataset_id", "column", "bin", "label", "count",
        rounded(F.try_divide(F.col("count") * 100.0, F.sum("count").over(w).cast("double")), 1).alias("share_pct"))


def empty_profile(spark: SparkSession) -> Profile:
    return Profile(*[local_table(spark, [], d) for d in (METRICS, COLUMNS, CORRELATIONS, DISTRIBUTIONS)])
