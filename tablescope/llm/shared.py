"""Small Spark helpers of the operators: reading the tables, bounded key filters, dense ranks, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

BITMAP_BITS = 1 << 26       # 8 MB at most, whatever the number of keys
_BUCKET = 32768             # bits in one row that bitmap_construct_agg makes


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name (names are matched without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def hash_share(df: DataFrame, keys: list[Column], salt: str) -> Column:
    """A repeatable number from 0 up to 1 for each key."""
    return F.pmod(F.xxhash64(F.lit(salt), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def may_hold(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``df`` plus a boolean ``name``: false only where ``key`` is certainly not among ``keys`` (its single column).

    A hashed bitmap of at most BITMAP_BITS is broadcast instead of the keys, so its size has a bound; false positives are left
    to the exact join that follows. No row of ``df`` is shuffled.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP_BITS))     # noqa: E731
    one = keys.select(place(F.col(keys.columns[0])).alias("_h"))
    at, bucket, no, bits = (free_name(df, x) for x in ("_at", "_bucket", "_no", "_bits"))
    bitmap = one.groupBy(F.floor(F.col("_h") / _BUCKET).alias(no)).agg(F.expr(f"bitmap_construct_agg(_h % {_BUCKET})").alias(bits))
    held = df.withColumn(at, place(key)).withColumn(bucket, F.floor(F.col(at) / _BUCKET))
    bit = F.col(at) % _BUCKET
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.call_function("bit_get", byte, (bit % 8).cast("int")) == 1
    joined = held.join(F.broadcast(bitmap), F.col(bucket) == F.col(no), "left")
    return joined.select(*[F.col(_quoted(c)) for c in df.columns], F.coalesce(found, F.lit(False)).alias(name))


def without(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not among ``keys`` (a single column). Rows that the bitmap clears stay where they are;
    only the others are shuffled for the exact anti-join."""
    flag, own, out, other = free_name(df, "_held"), free_name(df, "_key"), free_name(df, "_gone"), keys.columns[0]
    held = may_hold(df, key, keys, flag)
    unsure = held.where(quoted(flag)).withColumn(own, key)
    gone = keys.select(F.col(other).alias(out)).distinct()
    rest = unsure.join(gone, quoted(own) == F.col(out), "left_anti")
    columns = [quoted(c) for c in df.columns]
    return held.where(~quoted(flag)).select(*columns).unionByName(rest.select(*columns))


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def quoted(c: str) -> Column:
    return F.col(_quoted(c))


def dense_ranks(keys: DataFrame, by: list[str], label: str) -> DataFrame:
    """``keys`` (distinct rows of ``by``) plus ``rank``, the 1-based position in the order of ``by``: one range shuffle,
    frozen, then one offset for each partition."""
    frozen = materialize(keys.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), label)
    totals = frozen.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)     # one row for each partition
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(*by)
    return (frozen.join(F.broadcast(offsets), "_part")
            .select(*keys.columns, (F.col("_before") + F.row_number().over(within)).alias("rank")))


def components(edges: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (two columns of one type).

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round is two aggregates with map-side combining and
    two joins, edges never outnumber the first ones, and each round's edges are written to the shared folder.
    """
    a, b = edges.columns
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), label)
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = materialize(small, label)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
