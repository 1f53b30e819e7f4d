"""One-pass column statistics, learnt by a single aggregate job.

The result is one row whose width is bounded by the schema, so bringing it to
the driver is safe at any table size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import adjusted_kurtosis, adjusted_skew, numeric_columns, quoted


@dataclass
class ColumnStats:
    rows: int = 0
    count: dict[str, int] = field(default_factory=dict)
    values: dict[str, dict[str, float | None]] = field(default_factory=dict)

    def get(self, column: str, name: str):
        return self.values.get(column, {}).get(name)


_MEASURES = {
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "mean": lambda c: F.avg(c),
    "variance": lambda c: F.var_samp(c),
    "std": lambda c: F.stddev_samp(c),
    "std_pop": lambda c: F.stddev_pop(c),
    "skew": adjusted_skew,
    "kurtosis": adjusted_kurtosis,
    "min_filled": lambda c: F.min(F.coalesce(c, F.lit(0.0))),
    "max_filled": lambda c: F.max(F.coalesce(c, F.lit(0.0))),
}


COLUMNS_PER_JOB = 64     # keeps the generated code of one aggregate within the JVM's limits


def column_stats(df: DataFrame, numeric: list[str] | None = None, measures: tuple[str, ...] = (),
                 columns: list[str] | None = None) -> ColumnStats:
    """Row count, non-null counts of ``columns`` and ``measures`` of ``numeric``.

    Wide tables are taken some columns at a time; each job reads only its own.
    """
    columns = df.columns if columns is None else columns
    numeric = numeric_columns(df) if numeric is None else numeric
    if not measures:
        numeric = []
    every = list(dict.fromkeys(list(columns) + list(numeric)))
    chunks = [every[i:i + COLUMNS_PER_JOB] for i in range(0, len(every), COLUMNS_PER_JOB)] or [[]]
    out = ColumnStats()
    counted, measured = set(columns), set(numeric)
    for chunk in chunks:
        aggs = [F.count("*").alias("rows")]
        for i, c in enumerate(chunk):
            if c in counted:
                aggs.append(F.count(quoted(c)).alias(f"n_{i}"))
            if c in measured:
                aggs += [_MEASURES[m](quoted(c).cast("double")).alias(f"v_{i}_{m}") for m in measures]
        row = df.agg(*aggs).first()
        out.rows = row["rows"]
        for i, c in enumerate(chunk):
            if c in counted:
                out.count[c] = row[f"n_{i}"]
            if c in measured:
                out.values[c] = {m: row[f"v_{i}_{m}"] for m in measures}
    return out
