"""Mixing sources to target weights with hash-threshold histograms.

Each row has a size and a 64-bit hash. Sizes are summed by source and hash bucket; the bucket in which a source's budget
runs out is found from those sums, and only that bucket is split further, until it holds one hash. The row filter is then
``hash <= threshold`` - no sort, and the same rows at every rerun.

Defined results: null or empty texts have size 0 and take 0; a null source is a source of its own, ordered last; rows that
agree in id and text share a hash and are taken or left together; an empty table gives an empty result; very long texts are counted whole; columns that
have the names of output columns make these take underscores. Budgets are nested: a
smaller budget takes a subset of what a larger one takes. A whole row is taken or left, so a source misses its target by
at most half the size of the row (or of the equal rows) at its threshold.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .kernel import word_counts
from .shared import dense_ranks, free_name, quoted

BITS = 12           # hash bits resolved by one histogram
MAX_REPEAT = 3


def sized(docs: DataFrame, text: str = "text", name: str = "size") -> DataFrame:
    """``docs`` without its text, plus the number of words as ``name``."""
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*[quoted(c) for c in kept]).withColumn(name, F.lit(0).cast("bigint")).schema

    def count(batches):
        for b in batches:
            at = b.schema.get_field_index(text)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns) if i != at]
                                             + [pa.array(word_counts(b.column(at)))], names=[*kept, name])

    return docs.mapInArrow(count, schema)


def targets(sizes: DataFrame, weights=(1, 2, 3), share: float = 1.0, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all sizes; a target stops at
    ``max_repeat`` times its source's size and what is over is shared again by weight until no target is above its cap.
    """
    order = sizes.select("source", "source_size", F.col("source").isNull().alias("_last"), F.coalesce("source", F.lit("")).alias("_name"))
    ranked = dense_ranks(order, ["_last", "_name"], "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((F.col("rank") - 1) % len(weights)) + 1).cast("int"))
    rows = materialize(ranked.select("source", "source_size", weight.alias("weight"),
                                     (F.col("source_size").cast("double") * max_repeat).alias("cap")), "weights")
    total = rows.agg(F.sum("source_size")).first()[0]
    budget = float(total or 0) * share
    level, capped = 0.0, -1
    while True:         # every pass caps at least one source more
        over = F.col("cap") <= F.col("weight") * level
        full, spare, n = rows.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == capped or not spare:
            break
        capped, level = n, max(level, (budget - (full or 0.0)) / spare)
    return rows.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame, bits: int = BITS) -> DataFrame:
    """``goals`` (source, source_size, target) plus ``copies``, whole copies of every row, and ``cut``, the largest hash that gets one
    copy more (null: none). ``rows`` has source, size and hash (a bigint of 60 bits)."""
    total = 60
    # A source without words keeps its rows at no copy.
    state = goals.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("copies"),
    ).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    state = state.withColumn("open", F.col("rest") > 0).withColumn("prefix", F.lit(0).cast("bigint")) \
                 .withColumn("taken", F.lit(0).cast("bigint")).withColumn("cut", F.lit(None).cast("bigint"))
    state = materialize(state, "budgets")
    for level in range(1, total // bits + 1):
        left = total - bits * level
        bucket = F.shiftright(F.col("hash"), left)
        inside = rows.join(state.where("open").select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s"))).where(
            F.shiftright(F.col("hash"), left + bits) == F.col("prefix"))
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)      # 4,096 rows a source at most
        found = (sums.withColumn("upto", F.sum("words").over(run))
                 .join(state.where("open").select(F.col("source").alias("s"), "rest", "taken"), F.col("source").eqNullSafe(F.col("s")))
                 .where(F.col("upto") + F.col("taken") >= F.col("rest"))
                 .groupBy(F.col("s").alias("source2")).agg(F.min(F.struct("bucket", "upto", "words", "lo", "hi")).alias("b")))
        # One hash left in the bucket: with it or without it, whichever is nearer.
        before = F.col("taken") + F.col("b.upto") - F.col("b.words")
        single = F.col("b.lo") == F.col("b.hi")
        nearer = (before + F.col("b.words") - F.col("rest")) < (F.col("rest") - before)
        done = F.col("open") & single
        state = materialize(
            state.join(found, F.col("source").eqNullSafe(F.col("source2")), "left").select(
                "source", "source_size", "target", "copies", "rest",
                (F.col("open") & F.col("b").isNotNull() & ~F.coalesce(single, F.lit(True))).alias("open"),
                F.when(F.col("open"), F.col("b.bucket")).otherwise(F.col("prefix")).alias("prefix"),
                F.when(F.col("open") & F.col("b").isNotNull(), before).otherwise(F.col("taken")).alias("taken"),
                F.when(done & nearer, F.col("b.hi"))
                .when(F.col("open") & F.col("b").isNotNull(), F.shiftleft(F.col("b.bucket"), left) - 1)
                .otherwise(F.col("cut")).alias("cut")), "budgets")
        if not state.where("open").limit(1).count():
            break
    return state.select("source", "source_size", "target", "copies", "cut")


def _hash(docs: DataFrame, key: tuple[str, ...], text: str, salt: str):
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), *[quoted(k) for k in key], quoted(text)), 4)


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: tuple[str, ...] = ("doc_id",), salt: str = "mix",
        weights=(1, 2, 3), share: float = 1.0, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``docs`` without the text, plus size, source_size, target and repeats (how often the mix takes the row)."""
    size, digest = free_name(docs, "size"), free_name(docs, "hash")
    hashed = docs.withColumn(digest, _hash(docs, key, text, salt))
    narrow = materialize(sized(hashed, text, size), "sized")
    rows = narrow.select(quoted(source).cast("string").alias("source"), quoted(size).alias("size"), quoted(digest).alias("hash"))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    cuts = thresholds(rows, targets(sums, weights, share, max_repeat))
    # Few sources: Spark broadcasts the table when its size allows, and splits a hot source otherwise.
    cuts, at = _apart(cuts, docs)
    out = narrow.join(cuts, quoted(source).cast("string").eqNullSafe(F.col(at["source"])))
    kept = [quoted(c) for c in docs.columns if c != text]
    return out.select(*kept, quoted(size).alias(free_name(docs, "mix_size")), F.col(at["source_size"]).alias(free_name(docs, "mix_source_size")),
                      F.col(at["target"]).alias(free_name(docs, "mix_target")),
                      _times(at, digest, max_repeat).alias(free_name(docs, "mix_repeats")))


def _apart(cuts: DataFrame, docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``cuts`` under column names that ``docs`` does not have, and those names."""
    names = {c: free_name(docs, f"_{c}") for c in cuts.columns}
    return cuts.select(*[F.col(c).alias(n) for c, n in names.items()]), names


def _times(at: dict[str, str], digest: str, max_repeat: int):
    once_more = (quoted(digest) <= F.col(at["cut"])) & (F.col(at["copies"]) < max_repeat)
    return F.col(at["copies"]) + F.coalesce(once_more, F.lit(False)).cast("int")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: tuple[str, ...] = ("doc_id",), salt: str = "mix",
          weights=(1, 2, 3), share: float = 1.0, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``docs`` with each row as often as the mix takes it. The threshold of a row's source decides in place: sizes and cuts
    are looked up by source, so no text is shuffled when the sources are few."""
    size, digest = free_name(docs, "size"), free_name(docs, "hash")
    hashed = docs.withColumn(digest, _hash(docs, key, text, salt))
    narrow = materialize(sized(hashed, text, size).select(quoted(source).cast("string").alias("source"), quoted(size).alias("size"),
                                                          quoted(digest).alias("hash")), "sized")
    cuts = thresholds(narrow, targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeat))
    cuts, at = _apart(materialize(cuts, "cuts"), docs)
    out = hashed.join(cuts, quoted(source).cast("string").eqNullSafe(F.col(at["source"])))
    turns = F.explode(F.array_repeat(F.lit(0), _times(at, digest, max_repeat)))
    return out.withColumn(free_name(docs, "_turn"), turns).select(*[quoted(c) for c in docs.columns])
