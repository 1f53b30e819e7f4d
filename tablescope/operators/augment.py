"""Augmentation: SMOTE for uneven classes, bootstrap with noise for few rows.

Random choices come from hashes of a seed and a row's own content and copy
number, so a recomputed task makes the same rows again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import fold_nan, numeric_columns, quoted, text_columns
from ..session import materialize
from .neighbours import nearest, vector
from .quantiles import medians
from .stats import column_stats
from .value_counts import modes


@dataclass
class AugmentReport:
    success: bool
    method: str = ""
    rows_before: int = 0
    rows_after: int = 0
    rows_added: int = 0
    summary: str = ""
    classes: DataFrame | None = None        # (value, before, after) of a classification target


def _unit(*parts: Column) -> Column:
    """Uniform number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _normal(*parts: Column) -> Column:
    """Standard normal number from two hashes (Box-Muller)."""
    u = F.greatest(_unit(*parts, F.lit("a")), F.lit(1e-16))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(2 * 3.141592653589793) * _unit(*parts, F.lit("b")))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(value, count) of the non-null classes."""
    return (df.select(quoted(target).cast("string").alias("value")).where(F.col("value").isNotNull())
            .groupBy("value").agg(F.count("*").alias("count")))


CHUNK = 10_000      # draws that one row is spread into at a time
BUCKET = 20_000     # distinct rows of a hash bucket, on average
FAN = 256           # parts of one binomial split


def _places(rows: DataFrame, key: list[str], seed: int) -> DataFrame:
    """``rows`` (distinct, with ``grp`` and a count ``cnt``) plus ``start``, how many rows of the group stand before in the order of a hash
    of ``key``. Only bucket sums are ordered beyond a bucket, and a row of any count is one row."""
    n = max(1, min(1_000_000, rows.count() // BUCKET + 1))
    hashed = rows.withColumn("h", F.xxhash64(F.lit(seed), *map(quoted, key))).withColumn("bucket", F.pmod("h", F.lit(n)).cast("int"))
    sums = hashed.groupBy("grp", "bucket").agg(F.sum("cnt").alias("held"))
    before = Window.partitionBy("grp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sums.select(F.col("grp").alias("g"), F.col("bucket").alias("b"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset")), "offsets")
    inside = Window.partitionBy("grp", "bucket").orderBy("h", *key).rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("inside", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    return (placed.join(offsets, F.col("grp").eqNullSafe(F.col("g")) & (F.col("bucket") == F.col("b")))
            .withColumn("start", F.col("offset") + F.col("inside")).drop("g", "b", "offset", "inside", "h", "bucket"))


def _copies(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` as often as their column ``draws`` says, numbered by ``copy`` from 1. No row holds more than CHUNK copies, and chunks are dealt out to all tasks."""
    number = lambda a, b: F.explode(F.sequence(a.cast("bigint"), b.cast("bigint")))     # noqa: E731
    chunks = rows.where("draws > 0").withColumn("chunk", number(F.lit(0), F.floor((F.col("draws") - 1) / CHUNK))).repartition(*by, "chunk")
    return chunks.withColumn("copy", number(F.col("chunk") * CHUNK + 1, F.least(F.col("draws"), (F.col("chunk") + 1) * CHUNK))).drop("chunk")


def smote(df: DataFrame, target: str, k: int = 5, seed: int = 42, **block_sizes) -> DataFrame:
    """Bring every class to the size of the largest with points between same-class neighbours.

    Rows without a class are dropped; numeric gaps take the median. Base rows
    are used evenly (in hash order), the neighbour and the position between the
    two are drawn by hash. Other columns of new rows take the column mode.
    """
    df = fold_nan(df)
    features = [c for c in numeric_columns(df) if c != target]
    if len(features) < 2:
        raise ValueError("needs at least two numeric feature columns")
    mids = medians(df, features)
    label = quoted(target)
    base = df.where(label.isNotNull()).select(
        [F.coalesce(quoted(c).cast("double"), F.lit(mids[c] if mids[c] is not None else 0.0)).alias(c) if c in features else quoted(c)
         for c in df.columns])
    sizes = base.groupBy(label.cast("string").alias("grp")).agg(F.count("*").alias("size"))
    ends = sizes.agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("top")).first()
    if ends["n"] < 2:
        raise ValueError("needs at least two classes")
    if ends["low"] < 2:
        raise ValueError("the smallest class has a single row, so it has no neighbour")
    k = max(1, min(k, ends["low"] - 1))

    others = [c for c in df.columns if c not in features and c != target]
    small = sizes.where(F.col("size") < ends["top"])
    v = vector([quoted(c) for c in features])
    keyed = base.select(v.alias("x"), label.cast("string").alias("grp"), label.alias("label"))
    # Equal rows are one vector with a count: its places in the class say how many of the draws are its own.
    pool = materialize(keyed.join(small.select("grp"), "grp").groupBy("x", "grp").agg(F.count("*").alias("cnt"), F.min("label").alias("label")), "pool")
    asked = pool.select(F.col("x").alias("q"), F.lit(-1).alias("target"), "grp")
    found = nearest(asked, pool.select("x", "grp", "cnt"), len(features), k, own=True, **block_sizes)
    ring = found.groupBy("q", "grp").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("dist", "x", "weight"))),                      # at most k neighbours
        lambda s: F.array_repeat(s["x"], s["weight"].cast("int")))).alias("ring"))
    draws = F.lit(ends["top"]) - F.col("size")
    more = F.greatest(F.lit(0), F.least(draws % F.col("size") - F.col("start"), F.col("cnt")))
    ready = (_places(pool, ["x"], seed).join(small, "grp").withColumn("draws", F.col("cnt") * F.floor(draws / F.col("size")) + more)
             .select("x", "grp", "label", "draws").join(ring.withColumnRenamed("q", "x"), ["x", "grp"]))
    drawn = _copies(ready, ["grp", "x"])
    unit = lambda what: _unit(F.lit(seed), "grp", "x", "copy", F.lit(what))      # noqa: E731
    pick = F.floor(unit("n") * F.size("ring")).cast("int")
    made = drawn.select("label", F.zip_with("x", F.get("ring", pick), lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("ends"),
                        unit("u").alias("u")).select(
        "label", F.transform("ends", lambda e: e["a"] + F.col("u") * (e["b"] - e["a"])).alias("point"))
    top = modes(df, others) if others else {}
    unknown = lambda c: "Unknown" if c in text_columns(df) else None
    new = made.select([
        F.get("point", F.lit(features.index(c))).alias(c) if c in features
        else F.col("label").alias(c) if c == target
        else F.lit(top.get(c, unknown(c))).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    return base.unionByName(new)


def rows_to_add(n: int) -> int:
    """Grow to twice the rows or a thousand, but by no more than four times."""
    return min(max(2 * n, 1000) - n, 4 * n)


def _split(seed: int, level: int):
    """The draws of one node dealt to its children, at most FAN of them."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        held = table.column("held").to_numpy().astype(float)
        random = np.random.default_rng([seed, level, int(table.column("parent")[0].as_py())])
        return pa.table({"bucket": table.column("bucket"), "held": table.column("held"),
                         "draws": random.multinomial(int(table.column("draws")[0].as_py()), held / held.sum())})

    return run


def _shared_out(sizes: DataFrame, draws: int, seed: int) -> DataFrame:
    """(bucket, draws): ``draws`` dealt to the buckets (bucket, held) in proportion to what they hold, as drawing one by one would.

    Buckets are the leaves of a tree; every node splits its draws among at most FAN children by binomial splits, seeded by the node. So a bucket's
    number depends on sums only, and no draw has a number among all.
    """
    levels = [sizes.select("bucket", "held")]
    while levels[-1].limit(2).count() > 1:
        levels.append(materialize(levels[-1].groupBy(F.floor(F.col("bucket") / FAN).alias("bucket")).agg(F.sum("held").alias("held")), "nodes"))
    given = levels.pop().withColumn("draws", F.lit(draws).cast("bigint"))
    depth = len(levels)
    while levels:
        below, at = levels.pop(), len(levels)
        children = below.join(given.select(F.col("bucket").alias("parent"), "draws"), F.floor(F.col("bucket") / FAN) == F.col("parent"))

        given = materialize(children.groupBy("parent").applyInArrow(_split(seed, depth - at), "bucket bigint, held bigint, draws bigint"), "given")
    return given.select("bucket", "draws")


def bootstrap_noise(df: DataFrame, scale: float = 0.05, seed: int = 42) -> DataFrame:
    """Add resampled rows with normal noise of ``scale`` sample deviations on numbers.

    Rows are dealt to buckets by a hash of their content, equal rows as one with
    a count. Each bucket knows how many draws are its own (``_shared_out``) and makes
    them from the rows it holds, so the result does not depend on how the table is partitioned. Integer columns come back as doubles.
    """
    df = fold_nan(df)
    numeric = numeric_columns(df)
    stats = column_stats(df, numeric, ("std",), [])
    n = stats.rows
    if n == 0:
        return df
    wide = df.select([quoted(c).cast("double").alias(c) if c in numeric else quoted(c) for c in df.columns])
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = wide.toDF(*names)
    maps = [f.name for f in plain.schema.fields if isinstance(f.dataType, T.MapType)]      # neither grouped nor hashed by Spark
    key = [c for c in names if c not in maps]
    counted = plain.withColumn("cnt", F.lit(1).cast("bigint")) if maps else plain.groupBy(*names).agg(F.count("*").alias("cnt"))
    h = F.xxhash64(F.lit(seed), *key)
    buckets = n // BUCKET + 1
    dealt = materialize(counted.withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(buckets))), "dealt")
    given = _shared_out(dealt.groupBy("bucket").agg(F.sum("cnt").alias("held")), rows_to_add(n), seed)
    given = materialize(given.select(F.col("bucket").alias("b"), "draws"), "draws")

    def draw(left: pa.Table, right: pa.Table) -> pa.Table:
        """Rows of one bucket, and the draws it was given."""
        left = left.sort_by([("h", "ascending"), *[(c, "ascending") for c in key if not pa.types.is_nested(left.schema.field(c).type)]])
        upto = np.cumsum(left.column("cnt").to_numpy())
        wanted, bucket = (int(right.column(c)[0].as_py()) if right.num_rows else 0 for c in ("draws", "b"))
        random = np.random.default_rng([seed, 1 << 20, bucket])
        place = np.searchsorted(upto, random.integers(0, max(1, int(upto[-1]) if len(upto) else 1), wanted), "right")
        out = left.select(names).take(pa.array(place))
        return out.append_column("draw", pa.array(np.arange(wanted))).append_column("part", pa.array(np.full(wanted, bucket)))

    schema = T.StructType([*plain.schema.fields, T.StructField("draw", T.LongType()), T.StructField("part", T.LongType())])
    drawn = dealt.groupBy("bucket").cogroup(given.groupBy("b")).applyInArrow(draw, schema)
    noise = lambda i, c: _normal(F.lit(seed), F.lit(c), F.col("part"), F.col("draw")) * F.lit(stats.get(c, "std") * scale)
    noisy = {c for c in numeric if (stats.get(c, "std") or 0.0) > 0}
    new = drawn.select([(F.col(names[i]) + noise(i, c) if c in noisy else F.col(names[i])).alias(c) for i, c in enumerate(df.columns)])
    return wide.unionByName(new)


def augment(df: DataFrame, target: str, task: str = "classification", method: str = "auto", seed: int = 42):
    """(table or None, report). ``auto`` is SMOTE for classification, else bootstrap."""
    if target not in df.columns:
        return None, AugmentReport(False, summary=f"no column {target}")
    if method == "auto":
        method = "smote" if task == "classification" else "bootstrap"
    if method not in ("smote", "bootstrap"):
        return None, AugmentReport(False, summary=f"unknown method {method}")
    before = df.count()
    try:
        out = smote(df, target, seed=seed) if method == "smote" else bootstrap_noise(df, seed=seed)
    except ValueError as problem:
        return None, AugmentReport(False, method, before, before, 0, str(problem))
    after, classes = out.count(), None
    if task == "classification":
        counts = class_distribution(df, target).select("value", F.col("count").alias("before"), F.lit(0).cast("bigint").alias("after")).unionByName(
            class_distribution(out, target).select("value", F.lit(0).cast("bigint").alias("before"), F.col("count").alias("after")))
        classes = counts.groupBy("value").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    return out, AugmentReport(True, method, before, after, after - before, f"{after - before} rows added by {method}", classes)


def augment_gate(metrics: DataFrame, bias: DataFrame, recommendation: DataFrame) -> DataFrame:
    """Tables worth augmenting: under 1000 rows or uneven classes, with a known target."""
    uneven = bias.where(F.col("type") == "class_imbalance").select("dataset_id").distinct().withColumn("uneven", F.lit(True))
    return (metrics.join(uneven, "dataset_id", "left").join(recommendation.select("dataset_id", "task", "target"), "dataset_id")
            .where(F.col("target").isNotNull() & ((F.col("rows") < 1000) | F.col("uneven")))
            .select("dataset_id", "rows", F.coalesce("uneven", F.lit(False)).alias("uneven"), "task", "target"))
