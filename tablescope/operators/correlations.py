"""Pairwise-complete Pearson correlations.

Values are centred on the column means first, so plain sums of products are
exact enough. Narrow tables sum them in one JVM aggregate; wide tables multiply
matrices in Arrow batches (numpy inside the task). Either way it is one scan,
and the shuffle carries only per-pair sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import numeric_columns, quoted, rounded
from ..session import local_table
from .stats import ColumnStats, column_stats

MAX_JVM_COLUMNS = 12


def pair_correlations(df: DataFrame, columns: list[str] | None = None, min_pairs: int = 1,
                      stats: ColumnStats | None = None) -> DataFrame:
    """(column1, column2, pos1, pos2, pairs, value) for every pair, left to right.

    ``value`` is null when either side is constant over the shared rows or when
    fewer than ``min_pairs`` rows are shared. Pass ``stats`` with the means,
    minima and maxima to save the job that learns them.
    """
    columns = numeric_columns(df) if columns is None else columns
    if stats is None:
        stats = column_stats(df, columns, ("mean", "min", "max"), columns)
    centred = [quoted(c).cast("double") - F.lit(stats.get(c, "mean") or 0.0) for c in columns]
    data = df.select([x.alias(f"x{i}") for i, x in enumerate(centred)])
    full = [stats.count[c] == stats.rows for c in columns]
    sums = _by_aggregate(data, full) if len(columns) <= MAX_JVM_COLUMNS else _by_matrix(data, len(columns))

    n = F.col("n")
    mean_free = lambda ab, a, b: F.col(ab) - F.try_divide(F.col(a) * F.col(b), n)
    cov, va, vb = mean_free("sab", "sa", "sb"), mean_free("saa", "sa", "sa"), mean_free("sbb", "sb", "sb")
    flat = F.array(*[F.lit(stats.get(c, "min") == stats.get(c, "max")) for c in columns])
    constant = flat[F.col("i")] | flat[F.col("j")] | (va <= 1e-12 * F.col("saa")) | (vb <= 1e-12 * F.col("sbb"))
    r = F.when(~constant & (n >= min_pairs), F.try_divide(cov, F.sqrt(va * vb)))
    names = F.array(*[F.lit(c) for c in columns])
    value = F.when(F.abs(r) < float("inf"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return sums.select(names[F.col("i")].alias("column1"), names[F.col("j")].alias("column2"),
                       F.col("i").alias("pos1"), F.col("j").alias("pos2"), n.cast("bigint").alias("pairs"), value.alias("value"))


_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def _by_aggregate(data: DataFrame, full: list[bool]) -> DataFrame:
    """Sums per pattern of gaps in one aggregate, from which those of each pair follow.

    A row's pattern says which of the columns with gaps are null. Within a pattern every pair has the same rows,
    so columns share their sums, and the aggregate stays narrow enough for generated code.
    """
    p, spark = len(full), data.sparkSession
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]
    if not pairs:
        return spark.sql("select 0 as i, 0 as j, 0D as n, 0D as sa, 0D as sb, 0D as saa, 0D as sbb, 0D as sab where false")
    bit = {i: 1 << k for k, i in enumerate(i for i in range(p) if not full[i])}
    gaps = sum((F.when(F.col(f"x{i}").isNull(), b).otherwise(0) for i, b in bit.items()), F.lit(0))
    data = data.select(gaps.alias("gaps"), *[F.coalesce(f"x{i}", F.lit(0.0)).alias(f"x{i}") if i in bit else F.col(f"x{i}") for i in range(p)])
    sums = data.groupBy("gaps").agg(
        F.count("*").cast("double").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(p)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)])
    both = lambda i, j: F.col("gaps").bitwiseAND(bit.get(i, 0) | bit.get(j, 0)) == 0
    of = lambda i, j: F.when(both(i, j), F.struct(
        F.lit(i).alias("i"), F.lit(j).alias("j"),
        *[F.col(c).alias(a) for a, c in zip(_SUMS, ("n", f"s{i}", f"s{j}", f"s{i}_{i}", f"s{j}_{j}", f"s{i}_{j}"))]))
    found = sums.select(F.explode(F.array_compact(F.array(*[of(i, j) for i, j in pairs]))).alias("p")).select("p.*")
    none = local_table(spark, [{"i": i, "j": j, "n": 0.0} for i, j in pairs],       # pairs without a shared row
                       "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS))
    return found.unionByName(none).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _by_matrix(data: DataFrame, p: int) -> DataFrame:
    """The same sums for every pair as matrix products over Arrow batches."""
    upper_i, upper_j = np.triu_indices(p, k=1)

    def accumulate(batches):
        sums = np.zeros((6, p, p))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            seen = ~np.isnan(x)
            m = seen.astype(float)
            x = np.where(seen, x, 0.0)
            sums[0] += m.T @ m
            sums[1] += x.T @ m
            sums[2] += m.T @ x
            sums[3] += (x * x).T @ m
            sums[4] += m.T @ (x * x)
            sums[5] += x.T @ x
        flat = [s[upper_i, upper_j] for s in sums]
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper_i.astype("int32")), pa.array(upper_j.astype("int32"))] + [pa.array(f) for f in flat],
            names=["i", "j", *_SUMS])

    parts = data.mapInArrow(accumulate, "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS))
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])


def correlations(df: DataFrame, top_n: int = 20, min_pairs: int = 10, stats: ColumnStats | None = None) -> DataFrame:
    """The strongest pairs: (rank, column1, column2, value)."""
    pairs = (
        pair_correlations(df, min_pairs=min_pairs, stats=stats)
        .withColumn("value", rounded(F.col("value"), 4))
        .where(F.col("value").isNotNull())
        .orderBy(F.abs("value").desc(), "pos1", "pos2").limit(top_n)
    )
    order = Window.orderBy(F.abs("value").desc(), "pos1", "pos2")   # top_n rows
    return pairs.select(F.row_number().over(order).alias("rank"), "column1", "column2", "value")


def correlation_matrix(pairs: DataFrame, max_cols: int = 12) -> DataFrame:
    """Square view of a pair list for display: diagonal 1, unknown pairs 0.

    Columns are taken in order of first appearance in the list; at most
    ``max_cols`` of them, so the square holds at most ``max_cols``² cells.
    """
    seen = (
        pairs.select(F.explode(F.array(
            F.struct((F.col("rank") * 2).alias("at"), F.col("column1").alias("name")),
            F.struct((F.col("rank") * 2 + 1).alias("at"), F.col("column2").alias("name")))).alias("s"))
        .groupBy("s.name").agg(F.min("s.at").alias("at"))
        .orderBy("at").limit(max_cols)
    )
    names = seen.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda s: s["name"]).alias("names"))
    cells = (
        names.select("names", F.posexplode("names").alias("row_pos", "row"))
        .select("row_pos", "row", F.posexplode("names").alias("col_pos", "col"))
    )
    both = pairs.select(F.col("column1").alias("row"), F.col("column2").alias("col"), "value").unionByName(
        pairs.select(F.col("column2").alias("row"), F.col("column1").alias("col"), "value"))
    return cells.join(both, ["row", "col"], "left").select(
        "row_pos", "col_pos", "row", "col",
        F.when(F.col("row") == F.col("col"), 1.0).otherwise(F.coalesce("value", F.lit(0.0))).alias("value"))


def correlation_highlights(pairs: DataFrame, floor: float = 0.3, top_n: int = 3) -> DataFrame:
    return (pairs.where(F.abs("value") > floor)
            .orderBy(F.abs("value").desc(), "rank").limit(top_n))


def strength_label(value) -> Column:
    size = F.abs(value)
    return (F.when(size >= 0.9, "Very Strong").when(size >= 0.7, "Strong")
            .when(size >= 0.5, "Moderate").when(size >= 0.3, "Weak").otherwise("Very Weak"))


def target_correlations(pairs: DataFrame, target: str | None = None, top_n: int = 12) -> DataFrame:
    """Pairs that touch ``target`` (all pairs when None), strongest first."""
    if target is None:
        view = pairs.withColumn("feature", F.concat_ws(" / ", "column1", "column2"))
    else:
        view = (pairs.where((F.col("column1") == target) | (F.col("column2") == target))
                .withColumn("feature", F.when(F.col("column1") == target, F.col("column2")).otherwise(F.col("column1"))))
    return (view.orderBy(F.abs("value").desc(), "rank").limit(top_n)
            .select("feature", "value", strength_label(F.col("value")).alias("strength")))
