"""Equal-width histograms: learn the range in one job, count bins in the next.

One aggregate counts, for every inner edge of every column, the values at or
above it; the differences are the bins. A value that falls exactly on an edge
is in the bin that starts there, the last bin is closed. Each task sends one
row of counts, whatever the size of the table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import quoted
from ..session import local_table


@dataclass
class Bins:
    column: str
    lo: float
    hi: float
    n: int

    def __post_init__(self):
        if self.lo == self.hi:          # a zero-width range is opened by half a unit each way
            self.lo, self.hi = self.lo - 0.5, self.hi + 0.5

    @property
    def width(self) -> float:
        return (self.hi - self.lo) / self.n

    def edge(self, i: int) -> float:
        return self.hi if i == self.n else i * self.width + self.lo

    def usable(self) -> bool:
        return math.isfinite(self.lo) and math.isfinite(self.hi)


def log_bins(n: int, low: int, high: int) -> int:
    """Number of bins for ``n`` values: 1 + log2(n), held between low and high."""
    return min(high, max(low, int(math.log2(n) + 1)))


def histogram_counts(df: DataFrame, bins: list[Bins]) -> DataFrame:
    """(column, bin, lo, hi, count), empty bins included."""
    aggs = []
    for k, b in enumerate(bins):
        x = quoted(b.column).cast("double")
        aggs += [F.count(F.when(x >= b.edge(i), True)).alias(f"k{k}_{i}") for i in range(1, b.n)]
        aggs.append(F.count(x).alias(f"k{k}_0"))
    row = df.agg(*aggs).first()
    out = []
    for k, b in enumerate(bins):
        from_edge = [row[f"k{k}_{i}"] for i in range(b.n)] + [0]
        out += [{"column": b.column, "bin": i, "lo": b.edge(i), "hi": b.edge(i + 1), "count": from_edge[i] - from_edge[i + 1]}
                for i in range(b.n)]
    return local_table(df.sparkSession, out, "column string, bin int, lo double, hi double, count bigint")


def top_values(df: DataFrame, columns: list[str], keep: int) -> DataFrame:
    """(column, bin, value, count): the ``keep`` most frequent values of each
    column, then an 'Other' row for the rest. Ties go to the smaller value.

    A distributed top-k per column, so a column with billions of distinct values
    never sits in one task; the total comes from one count over all columns.
    """
    totals = df.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    parts = []
    for i, name in enumerate(columns):
        counts = (df.select(quoted(name).cast("string").alias("value")).where(F.col("value").isNotNull())
                  .groupBy("value").agg(F.count("*").alias("count")))
        top = counts.orderBy(F.desc("count"), "value").limit(keep)       # TakeOrderedAndProject
        listed = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("neg"), "value")))      # at most keep entries
        one = top.agg(listed.alias("top"), F.coalesce(F.sum("count"), F.lit(0)).alias("shown"))
        rest = F.lit(totals[f"n{i}"]) - F.col("shown")
        other = F.when(rest > 0, F.array(F.struct((-rest).alias("neg"), F.lit("Other").alias("value")))).otherwise(F.slice("top", 1, 0))
        parts.append(one.select(F.posexplode(F.concat("top", other)).alias("bin", "e")).select(
            F.lit(name).alias("column"), "bin", F.col("e.value").alias("value"), (-F.col("e.neg")).alias("count")))
    return reduce(DataFrame.unionByName, parts)
