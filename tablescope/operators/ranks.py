"""Global ranks of distinct values without a single-partition window.

Values are counted (hot values combine map-side), range-partitioned and frozen
in the shared folder together with their partition number; each partition's
total then becomes an offset, so running positions are computed in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def value_ranks(df: DataFrame, value: Column, weight: Column | None = None) -> DataFrame:
    """(value, count, index, before): ``index`` is the 0-based dense rank of the
    value, ``before`` the number of rows with a smaller value. Nulls are left out."""
    counts = (
        df.select(value.alias("value"), (weight if weight is not None else F.lit(1)).cast("bigint").alias("w"))
        .where(F.col("value").isNotNull())
        .groupBy("value").agg(F.sum("w").alias("count"))
    )
    frozen = materialize(
        counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "ranks"
    )
    totals = frozen.groupBy("part").agg(F.count("*").alias("values"), F.sum("count").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("values").over(earlier), F.lit(0)).alias("value_offset"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("row_offset"),
    )
    running = Window.partitionBy("part").orderBy("value")
    so_far = running.rowsBetween(Window.unboundedPreceding, 0)
    return (
        frozen.join(F.broadcast(offsets), "part")   # at most spark.sql.shuffle.partitions rows
        .select(
            "value", "count",
            (F.col("value_offset") + F.row_number().over(running) - 1).alias("index"),
            (F.col("row_offset") + F.sum("count").over(so_far) - F.col("count")).alias("before"),
        )
    )


def spaced_positions(ranks: DataFrame, n: int, points: int) -> DataFrame:
    """Rows of ``ranks`` at ``points`` evenly spaced row positions 0..n-1.

    Position ``i`` is ``floor(i*step)`` with ``step = (n-1)/(points-1)``, the last one ``n-1``; a repeated value comes
    once per position it covers. Result: ``ranks`` columns plus ``i``.
    """
    step = (n - 1) / (points - 1) if points > 1 else 0.0
    place = lambda i: F.when(i == points - 1, F.lit(n - 1).cast("bigint")).otherwise(
        F.floor(i.cast("double") * F.lit(step)).cast("bigint"))
    first, last = F.col("before"), F.col("before") + F.col("count") - 1
    guess = F.floor(first / F.lit(step or 1.0)).cast("int")
    span = F.ceil((last - first) / F.lit(step or 1.0)).cast("int")
    low = F.greatest(F.lit(0), guess - 2)
    high = F.least(F.lit(points - 1), guess + span + 2)
    candidates = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    kept = F.filter(candidates, lambda i: (place(i) >= first) & (place(i) <= last))
    return ranks.withColumn("i", F.explode(kept))
