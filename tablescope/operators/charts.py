"""Chart data: every function returns a DataFrame of points or bars, and most a
one-row DataFrame of statistics next to it. Boolean columns count as categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import fold_nan, is_numeric, quoted, rounded, rounded_value
from ..functions.text import fixed, truncate_label
from ..session import local_table
from .correlations import pair_correlations
from .histograms import Bins, histogram_counts, log_bins, top_values
from .profile import Profile
from .quantiles import exact_quantiles
from .ranks import spaced_positions, value_ranks
from .stats import column_stats
from .value_counts import most_common

LIMITS = {"histogram": (1, 1), "scatter": (2, 2), "boxplot": (1, 5), "violin": (1, 1), "pie": (1, 1), "area": (1, 1),
          "heatmap": (2, 12), "line": (2, 2)}


class ChartError(ValueError):
    """The chart cannot be drawn from these columns."""


def check_columns(df: DataFrame, chart: str, columns: list[str]) -> None:
    """Fail before any job runs when a chart does not fit its columns."""
    if chart not in LIMITS:
        raise ChartError(f"unknown chart {chart}; use one of {', '.join(LIMITS)}")
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ChartError(f"no such column: {', '.join(unknown)}")
    least, most = LIMITS[chart]
    if not least <= len(columns) <= most:
        raise ChartError(f"{chart} takes {least} to {most} columns, not {len(columns)}")


def _need_number(df: DataFrame, *columns: str) -> None:
    for c in columns:
        if not is_numeric(df.schema[c]):
            raise ChartError(f"{c} is not numeric")


def _stats_table(df: DataFrame, values: dict[str, float | int | None], whole: tuple[str, ...] = ()) -> DataFrame:
    row = {k: v if k in whole else rounded_value(v, 4) for k, v in values.items()}
    return local_table(df.sparkSession, [row], ", ".join(f"{k} {'bigint' if k in whole else 'double'}" for k in row))


def histogram(df: DataFrame, column: str, bins: int = 0, normalize: bool = False) -> tuple[DataFrame, DataFrame]:
    """(bars, stats). Numeric: equal-width bins with count or density; otherwise
    the 25 most frequent values and the rest."""
    check_columns(df, "histogram", [column])
    df = fold_nan(df).select(quoted(column))
    if not is_numeric(df.schema[column]):
        bars = top_values(df, [column], 25).select("bin", truncate_label(F.col("value")).alias("label"), "count")
        stats = most_common(df, [column]).select(
            F.col("unique_count").alias("unique_values"), F.col("mode").alias("most_common"),
            rounded(F.col("mode_count") * 100.0 / F.col("non_null").cast("double"), 1).alias("most_common_pct"))
        return bars, stats
    s = column_stats(df, [column], ("mean", "std", "min", "max", "skew"))
    n = s.count[column]
    if n == 0:
        raise ChartError(f"{column} has no values")
    wanted = bins if bins >= 5 else log_bins(n, 6, 30)
    b = Bins(column, s.get(column, "min"), s.get(column, "max"), max(5, min(100, wanted)))
    text = lambda x: F.when(F.abs("hi") < 1000, fixed(x, 2)).otherwise(fixed(x, 0))
    label = F.concat(text(F.col("lo")), F.lit(" – "), text(F.col("hi")))
    bars = histogram_counts(df, [b])
    if normalize:
        density = rounded(F.col("count") / F.lit(float(n)) / F.lit(b.width), 6)
        bars = bars.select("bin", label.alias("label"), density.alias("density"))
    else:
        bars = bars.select("bin", label.alias("label"), "count")
    median = exact_quantiles(df, {column: [0.5]})[column][0.5]
    stats = _stats_table(df, {"mean": s.get(column, "mean"), "median": median, "std": s.get(column, "std"), "min": s.get(column, "min"),
                              "max": s.get(column, "max"), "skewness": s.get(column, "skew"), "bins": b.n}, ("bins",))
    return bars, stats


def scatter(df: DataFrame, x: str, y: str, key: list[str] | str, points: int | None = 2000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(points, stats). A sample of ``points`` rows in hash order of ``key`` when
    there are more; correlation and ranges are those of the sample. All rows
    with ``points=None``."""
    check_columns(df, "scatter", [x, y])
    _need_number(df, x, y)
    keys = [key] if isinstance(key, str) else list(key)
    tag = F.md5(F.concat_ws("|", F.lit(str(seed)), *[quoted(k).cast("string") for k in keys]).cast("binary"))
    clean = fold_nan(df).select(quoted(x).cast("double").alias("x"), quoted(y).cast("double").alias("y"), tag.alias("tag"))
    chosen = clean.where("x is not null and y is not null")
    if points is not None:
        chosen = chosen.orderBy("tag", "x", "y").limit(points)      # TakeOrderedAndProject
    r = F.try_divide(F.covar_pop("x", "y"), F.sqrt(F.var_pop("x") * F.var_pop("y")))
    stats = chosen.agg(rounded(r, 4).alias("correlation"), F.count("*").alias("points"),
                       *[rounded(f(c), 4).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])
    return chosen.select(rounded(F.col("x"), 4).alias("x"), rounded(F.col("y"), 4).alias("y")), stats


def boxplot(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per numeric column (five at most): quartiles, whiskers, outlier
    count and up to 50 outliers (smallest first)."""
    check_columns(df, "boxplot", columns)
    df = fold_nan(df)
    cols = [c for c in columns if is_numeric(df.schema[c])]
    counts = column_stats(df, [], (), cols).count
    cols = [c for c in cols if counts[c] >= 5]
    if not cols:
        raise ChartError("no numeric column with enough values")
    q = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols})
    aggs = []
    for i, c in enumerate(cols):
        x, iqr = quoted(c).cast("double"), q[c][0.75] - q[c][0.25]
        aggs += [F.min(F.when(x >= q[c][0.25] - 1.5 * iqr, x)).alias(f"lo{i}"), F.max(F.when(x <= q[c][0.75] + 1.5 * iqr, x)).alias(f"hi{i}")]
    whiskers = df.agg(*aggs).first()
    ends = {c: (whiskers[f"lo{i}"], whiskers[f"hi{i}"]) for i, c in enumerate(cols)}
    outside = lambda c: (quoted(c).cast("double") < ends[c][0]) | (quoted(c).cast("double") > ends[c][1])
    beyond = df.agg(*[F.count(F.when(outside(c), True)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    rows = []
    for i, c in enumerate(cols):
        some = df.where(outside(c)).select(quoted(c).cast("double").alias("v")).orderBy("v").limit(50).collect() if beyond[f"n{i}"] else []
        rows.append({"column": c, "min": rounded_value(ends[c][0], 4), "q1": rounded_value(q[c][0.25], 4), "median": rounded_value(q[c][0.5], 4),
                     "q3": rounded_value(q[c][0.75], 4), "max": rounded_value(ends[c][1], 4),
                     "outliers": [rounded_value(r["v"], 4) for r in some], "outlier_count": beyond[f"n{i}"]})
    return local_table(df.sparkSession, rows, "column string, min double, q1 double, median double, q3 double, max double, "
                                              "outliers array<double>, outlier_count bigint")


def violin(df: DataFrame, column: str, bins: int = 0) -> tuple[DataFrame, DataFrame]:
    """(curve, stats): density in 50 bins smoothed by a three-bin mean."""
    check_columns(df, "violin", [column])
    _need_number(df, column)
    df = fold_nan(df).select(quoted(column))
    s = column_stats(df, [column], ("mean", "std", "min", "max", "skew", "kurtosis"))
    n = s.count[column]
    if n < 10:
        raise ChartError("too few values for a violin chart")
    b = Bins(column, s.get(column, "min"), s.get(column, "max"), bins if bins >= 10 else 50)
    order = Window.orderBy("bin")                       # one row per bin
    near = lambda c: F.coalesce(c, F.lit(0.0))
    density = F.col("count") / F.lit(float(n)) / F.lit(b.width)
    smooth = (near(F.lag("d").over(order)) + F.col("d") + near(F.lead("d").over(order))) / 3.0
    curve = (histogram_counts(df, [b]).withColumn("d", density).withColumn("s", smooth)
             .withColumn("top", F.max("s").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    out = curve.select("bin", rounded((F.col("lo") + F.col("hi")) / 2, 4).alias("value"), rounded(F.col("s"), 6).alias("density"),
                       rounded(F.col("s") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0) * 100, 1).alias("density_pct"))
    median = exact_quantiles(df, {column: [0.5]})[column][0.5]
    stats = _stats_table(df, {"mean": s.get(column, "mean"), "median": median, "std": s.get(column, "std"), "skewness": s.get(column, "skew"),
                              "kurtosis": s.get(column, "kurtosis"), "n": n}, ("n",))
    return out, stats


def pie(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(slices, stats): the ten most frequent values and the rest, with shares."""
    check_columns(df, "pie", [column])
    df = fold_nan(df).select(quoted(column))
    share = F.try_divide(F.col("count") * 100.0, F.sum("count").over(Window.partitionBy("column")).cast("double"))    # 11 rows
    slices = top_values(df, [column], 10).select("bin", truncate_label(F.col("value")).alias("label"), "count",
                                                 rounded(share, 1).alias("percentage"))
    stats = most_common(df, [column]).select(
        F.col("non_null").alias("total_values"), F.col("unique_count").alias("unique_categories"), F.col("mode").alias("top_category"),
        rounded(F.col("mode_count") * 100.0 / F.col("non_null").cast("double"), 1).alias("top_pct"))
    return slices, stats


def area(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(curve, stats): cumulative distribution, at 200 evenly spaced ranks when
    there are more than 500 values, and six percentiles of all values."""
    check_columns(df, "area", [column])
    _need_number(df, column)
    df = fold_nan(df).select(quoted(column))
    n = column_stats(df, [], ()).count[column]
    ranks = value_ranks(df, quoted(column).cast("double") + F.lit(0.0))
    shown = 200 if n > 500 else n
    if n > 500:
        points = spaced_positions(ranks, n, shown)
    else:
        points = ranks.withColumn("i", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("count") - 1)))
    curve = points.select(F.col("i").cast("int").alias("i"), rounded(F.col("value"), 4).alias("value"),
                          rounded((F.col("i") + 1) * 100.0 / F.lit(float(shown or 1)), 2).alias("cumulative_pct"))
    probs = [0.10, 0.25, 0.50, 0.75, 0.90, 0.99]
    q = exact_quantiles(df, {column: probs})[column]
    return curve, _stats_table(df, {f"p{int(p * 100)}": q[p] for p in probs})


def heatmap(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cells, stats): full correlation square over at most 12 numeric columns;
    the diagonal of a constant column and unknown pairs are 0."""
    check_columns(df, "heatmap", columns)
    df = fold_nan(df)
    cols = [c for c in columns if is_numeric(df.schema[c])]
    if len(cols) < 2:
        raise ChartError("a heatmap needs at least two numeric columns")
    s = column_stats(df, cols, ("min", "max"), [])
    own = local_table(df.sparkSession, [
        {"row_pos": i, "col_pos": i, "row": c, "col": c, "value": 0.0 if s.get(c, "min") in (None, s.get(c, "max")) else 1.0}
        for i, c in enumerate(cols)], "row_pos int, col_pos int, row string, col string, value double")
    pairs = local_table(df.sparkSession, [r.asDict() for r in pair_correlations(df, cols).collect()],       # at most 66 pairs
                        "column1 string, column2 string, pos1 int, pos2 int, pairs bigint, value double")
    side = lambda i, j: pairs.select(F.col(f"pos{i}").alias("row_pos"), F.col(f"pos{j}").alias("col_pos"),
                                     F.col(f"column{i}").alias("row"), F.col(f"column{j}").alias("col"), "value")
    off = side(1, 2).unionByName(side(2, 1))
    cells = off.unionByName(own).select("row_pos", "col_pos", "row", "col", F.coalesce(rounded(F.col("value"), 4), F.lit(0.0)).alias("value"))
    ranked = off.where(F.col("value").isNotNull())
    name = lambda s: F.when(s.isNotNull(), F.concat(s["row"], F.lit(" / "), s["col"], F.lit(" ("), fixed(s["value"], 3), F.lit(")")))
    lowest = F.min(F.struct("value", "row_pos", "col_pos", "row", "col"))
    highest = F.min(F.struct((-F.col("value")).alias("neg"), "row_pos", "col_pos", "row", "col", "value"))
    stats = ranked.agg(highest.alias("h"), lowest.alias("l")).select(
        F.lit(len(cols)).alias("size"), name(F.col("h")).alias("strongest_positive"), name(F.col("l")).alias("strongest_negative"))
    return cells, stats


def line(df: DataFrame, x: str, y: str, key: list[str] | str) -> tuple[DataFrame, DataFrame]:
    """(points, stats): sorted by x when x is numeric, else by ``key``; at 300
    evenly spaced rows when there are more than 500. ``key`` also orders equal x."""
    check_columns(df, "line", [x, y])
    _need_number(df, y)
    keys = [key] if isinstance(key, str) else list(key)
    numeric_x = is_numeric(df.schema[x])
    df = fold_nan(df)
    by = ([quoted(x).cast("double").alias("k")] if numeric_x else []) + [quoted(k).alias(f"k{i}") for i, k in enumerate(keys)]
    clean = df.where(quoted(x).isNotNull() & quoted(y).isNotNull())
    shown_x = rounded(quoted(x).cast("double"), 4) if numeric_x else truncate_label(quoted(x), 20)
    row = F.struct(*by, shown_x.alias("x"), quoted(y).cast("double").alias("y"))
    n = clean.count()
    shown = 300 if n > 500 else n
    ranks = value_ranks(clean, row)
    if n > 500:
        points = spaced_positions(ranks, n, shown)
    else:
        points = ranks.withColumn("i", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("count") - 1)))
    out = points.select(F.col("i").cast("int").alias("i"), F.col("value.x").alias("x"), rounded(F.col("value.y"), 4).alias("y"))
    mean = df.agg(F.avg(quoted(y).cast("double"))).first()[0]
    trend = F.when((F.count("*") > 1) & (F.max_by("y", "i") > F.min_by("y", "i")), "increasing").otherwise("decreasing")
    return out, out.agg(F.count("*").alias("points"), F.lit(rounded_value(mean, 4)).cast("double").alias("y_mean"), trend.alias("y_trend"))


def suggest_charts(p: Profile, top_n: int = 8) -> DataFrame:
    """(dataset_id, ord, chart_type, columns, priority): what is worth drawing."""
    number, text = F.col("type") == "number", F.col("type") == "string"
    per_table = Window.partitionBy("dataset_id")            # columns or suggestions of one table
    nth = lambda order: F.row_number().over(per_table.orderBy(*order))
    one = lambda c: F.array(c)

    scatter_ = (p.correlations.where(F.col("rank") <= 3).where(F.abs("value") >= 0.4)
                .select("dataset_id", F.lit("scatter").alias("chart_type"), F.array("column1", "column2").alias("columns"),
                        F.floor(rounded(F.abs("value") * 100, 6)).cast("int").alias("priority"), F.lit(0).alias("kind"), F.col("rank").alias("at")))
    pie_ = (p.columns.where(text & F.col("unique_count").between(2, 10))
            .select("dataset_id", F.lit("pie"), one(F.col("name")), F.lit(60), F.lit(1), F.col("position")))
    numbers = p.columns.where(number).withColumn("nth", nth(["position"]))
    histogram_ = numbers.where(F.col("nth") <= 3).select("dataset_id", F.lit("histogram"), one(F.col("name")), F.lit(40), F.lit(2), F.col("position"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("nth", "name"))), lambda s: s["name"])
    several = numbers.groupBy("dataset_id").agg(names.alias("names"))
    boxplot_ = (several.where(F.size("names") >= 2)
                .select("dataset_id", F.lit("boxplot"), F.slice("names", 1, 4), F.lit(50), F.lit(3), F.lit(0)))
    gaps = numbers.where(F.col("null_count") > 0).withColumn("by_gaps", nth([F.desc("null_count"), "position"]))
    violin_ = gaps.where(F.col("by_gaps") == 1).select("dataset_id", F.lit("violin"), one(F.col("name")), F.lit(45), F.lit(4), F.lit(0))
    heatmap_ = (several.where(F.size("names") >= 4)
                .select("dataset_id", F.lit("heatmap"), F.slice("names", 1, 8), F.lit(70), F.lit(5), F.lit(0)))
    every = scatter_.union(pie_).union(histogram_).union(boxplot_).union(violin_).union(heatmap_)
    ranked = every.withColumn("ord", nth([F.desc("priority"), "kind", "at"]))
    return ranked.where(F.col("ord") <= top_n).select("dataset_id", "ord", "chart_type", "columns", "priority")
