"""Near-duplicates by circulant MinHash (Li and Li, 2021), banding, and exact Jaccard.

Two permutations make all signature coordinates: the first scatters the shingles of a text over the places of the second, and
coordinate k is the smallest value of the second one, shifted by k places. A row of K neighbouring values is thus read once for
each shingle. Texts that share a band of coordinates are compared on their whole shingle sets.

How the work stays bounded: rows with equal shingle sets are one class. Buckets of up to SMALL classes give their pairs. In larger
ones every class is compared with one hub; classes that such buckets connect and that the comparisons have not joined yet are
compared block by block inside tasks, which give back only links that join something new. No link between candidates is lost and
no group is written out as pairs.

Defined results: null and empty texts have no shingles and link with nothing; a text of 1 to 4 words is one shingle; rows with equal
sets are linked; rows that repeat an id are one document; null ids never name a component unless it has no other id; an
empty table gives an empty result; very long texts count with all their shingles, in one array; only the id and text columns are read, so further
columns change nothing, whatever their names. At a similarity of 0.85 a pair is no candidate with probability 3e-6.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .kernel import mix, shingle_sets
from .shared import components, may_hold, quoted

BANDS, ROWS, SKETCH = 40, 8, 64
COORDINATES = BANDS * ROWS + SKETCH
PLACES_LOG = 21
SMALL = 32                  # classes in a bucket up to which its pairs are made
BLOCK_SHINGLES = 150_000    # shingles in a block of a larger group
SKETCH_SLACK = 0.25         # over five standard errors of a 64-coordinate estimate at 0.85

_tables: dict[str, np.ndarray] = {}


def _shifts() -> np.ndarray:
    """Row s: the second permutation's values at places s to s + K - 1, around the end."""
    if "shifts" not in _tables:
        values = np.random.default_rng(11).permutation(1 << PLACES_LOG).astype(np.int32)
        ring = np.concatenate([values, values[:COORDINATES - 1]])
        _tables["shifts"] = np.lib.stride_tricks.sliding_window_view(ring, COORDINATES)
        _tables["odd"] = np.random.default_rng(12).integers(1, 1 << 62, (1, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _tables["shifts"]


def signature(shingles: np.ndarray) -> np.ndarray:
    shifts = _shifts()
    places = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - PLACES_LOG)).astype(np.int64)
    out = np.full(COORDINATES, 1 << PLACES_LOG, np.int32)
    for i in range(0, len(places), 512):
        np.minimum(out, shifts[places[i:i + 512]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[:BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return mix((rows * _tables["odd"]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


MARKS = T.StructType([T.StructField("th", T.LongType()), T.StructField("n", T.LongType()), T.StructField("class", T.BinaryType()),
                      T.StructField("tag", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def marks(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, th, n, class, tag, bands, sketch) for each row: text hash, set size, digest of the set, its first 8 bytes, band keys, and
    one byte of each of the last coordinates."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *MARKS.fields])

    def run(batches):
        for b in batches:
            seen: dict[bytes, tuple] = {}
            rows = []
            for s in shingle_sets(b.column("text")):
                d = _digest(s)
                if d not in seen:
                    if len(s):
                        sig = signature(s)
                        seen[d] = (len(s), d, int.from_bytes(d[:8], "little", signed=True), band_keys(sig), (sig[BANDS * ROWS:] & 255).astype(np.uint8).tobytes())
                    else:
                        seen[d] = (0, d, 0, None, None)
                rows.append(seen[d])
            n, d, tag, bands, sketch = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("th"), pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.array(tag, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=schema.names)

    return docs.select(quoted(id_col).alias("id"), F.xxhash64(quoted(text)).alias("th"), quoted(text).alias("text")).mapInArrow(run, schema)


@dataclass
class Threshold:
    """intersection * parts >= whole * union"""
    whole: int = 85
    parts: int = 100

    @property
    def share(self) -> float:
        return self.whole / self.parts


def _sketch_filter(pairs: DataFrame, facts: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs (a, b) that the set sizes allow and whose sketches do not differ far more than at the threshold."""
    side = lambda x: facts.select(F.col("class").alias(x), F.col("n").alias("n_" + x), F.col("sketch").alias("s_" + x))     # noqa: E731
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(
        F.least("n_a", "n_b") * limit.parts >= F.greatest("n_a", "n_b") * limit.whole)
    least = int(SKETCH * (limit.share - SKETCH_SLACK))

    def run(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column("s_a").to_pylist()), np.uint8).reshape(-1, SKETCH)
            y = np.frombuffer(b"".join(b.column("s_b").to_pylist()), np.uint8).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return both.select("a", "b", "s_a", "s_b").mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    whole, parts = limit.whole, limit.parts
    both = (pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("s_a")), "a")
            .join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("s_b")), "b"))

    def run(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column("s_a"), b.column("s_b")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                joined = np.concatenate([x, y])
                joined.sort()
                common = int((joined[1:] == joined[:-1]).sum())
                good.append(parts * common >= whole * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "s_a", "s_b").mapInArrow(run, "a binary, b binary")


def _shingle_table(docs: DataFrame, id_col: str, text: str, wanted: DataFrame) -> DataFrame:
    """(class, shingles) of the classes in ``wanted`` (class, id, th), computed again from one text of each."""
    rows = docs.select(quoted(id_col).alias("id"), F.xxhash64(quoted(text)).alias("th"), quoted(text).alias("text"))
    key = lambda: F.xxhash64("id", "th")
    rows = may_hold(rows, key(), wanted.select(key().alias("k")), "_wanted").where("_wanted").select("text")

    def run(batches):
        for b in batches:
            found = {}
            for s in shingle_sets(b.column("text")):
                if len(s):
                    found.setdefault(_digest(s), s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.binary())], names=["class", "shingles"])

    return rows.mapInArrow(run, "class binary, shingles binary").dropDuplicates(["class"])


def _block_links(limit: Threshold):
    """Links between the two blocks of a group that join components which were apart."""
    whole, parts = limit.whole, limit.parts

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class", kind="stable")
        left, right = rows[rows.side == 0], rows[rows.side == 1]
        if not len(right):
            right = left
        parent = {c: c for c in rows.component}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        sets = [np.frombuffer(s, np.uint64) for s in right.shingles]
        values = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        sizes, names, comps = np.array([len(s) for s in sets]), right["class"].tolist(), right.component.tolist()
        out = []
        for name, component, s in zip(left["class"], left.component, left.shingles):
            s = np.frombuffer(s, np.uint64)
            lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(owners[at], minlength=len(sets))
            for j in np.flatnonzero(parts * common >= whole * (len(s) + sizes - common)):
                a, b = root(component), root(comps[j])
                if a != b:
                    parent[a] = b
                    out.append((name, names[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _group_links(hubs: DataFrame, links: DataFrame, facts: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """What the hubs have not settled: per group of larger buckets, all pairs of classes that are still apart, block by block."""
    groups = components(hubs, "groups").withColumnRenamed("node", "class").withColumnRenamed("component", "grp")
    joined = components(links, "joined").withColumnRenamed("node", "class")
    rows = materialize(groups.join(joined, "class", "left").join(facts.select("class", "n"), "class")
                       .select("class", "grp", "n", F.coalesce("component", "class").alias("component")), "apart")
    parts = rows.groupBy("grp", "component").agg(F.sum("n").alias("size"))
    apart = parts.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1").select("grp")
    # A component that fills blocks has blocks of its own; the others of a group share blocks.
    own = parts.where(F.col("size") > BLOCK_SHINGLES)
    rows = rows.join(apart, "grp").join(own.select("component", "grp", F.col("component").alias("pure")).drop("component").withColumnRenamed("grp", "g"),
                                        (F.col("grp") == F.col("g")) & (F.col("component") == F.col("pure")), "left").drop("g")
    room = rows.groupBy("grp", "pure").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("room")).select(F.col("grp").alias("g"), F.col("pure").alias("p"), "room")
    rows = rows.join(room, (F.col("grp") == F.col("g")) & F.col("pure").eqNullSafe(F.col("p"))).withColumn(
        "block", F.concat(F.coalesce(F.hex("pure"), F.lit("")), F.lit("/"), F.pmod(F.xxhash64("class"), F.col("room")).cast("string")))
    rows = materialize(rows.select("class", "grp", "component", "pure", "block"), "blocks")
    blocks = rows.select("grp", "block", "pure").distinct()
    other = blocks.select(F.col("grp").alias("g"), F.col("block").alias("block_b"), F.col("pure").alias("pure_b"))
    tasks = blocks.join(other, (F.col("grp") == F.col("g")) & (F.col("block") <= F.col("block_b"))).where(
        ~F.coalesce(F.col("pure") == F.col("pure_b"), F.lit(False)))
    sides = tasks.select("grp", F.struct("block", "block_b").alias("task"), F.col("block").alias("own"), F.lit(0).alias("side")).unionByName(
        tasks.where("block < block_b").select("grp", F.struct("block", "block_b").alias("task"), F.col("block_b").alias("own"), F.lit(1).alias("side")))
    held = rows.select(F.col("grp").alias("g"), "block", "class", "component").join(sets, "class")
    dealt = sides.join(held, (F.col("grp") == F.col("g")) & (F.col("own") == F.col("block"))).select("grp", "task", "side", "class", "component", "shingles")
    return dealt.groupBy("grp", "task").applyInPandas(_block_links(limit), "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: Threshold = Threshold()) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each row of ``docs``."""
    all_marks = materialize(marks(docs, id_col, text), "marks")
    full = all_marks.where("n > 0")
    # Facts of a class; the text it is computed from again is that of its smallest id.
    classes = materialize(full.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th")).alias("at"),
                                                    F.min("n").alias("n"), F.min("sketch").alias("sketch"))
                          .select("class", F.col("at.id").alias("id"), F.col("at.th").alias("th"), "n", "sketch"), "classes")
    dealt = full.select(F.explode("bands").alias("key"), "class", "tag")
    shared = dealt.groupBy("key").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).where("lo <> hi").select("key")
    members = materialize(may_hold(dealt.select("key", "class"), F.col("key"), shared, "_shared").where("_shared").select("key", "class").distinct(), "members")
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.min("class").alias("hub")).where("size > 1")
    sized = materialize(members.join(sizes, "key"), "buckets")
    lists = sized.where(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("class")).alias("m")).select("m").distinct()
    pairs = lists.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.slice("m", F.col("i") + 2, SMALL)).alias("b")).distinct()
    hubs = materialize(sized.where((F.col("size") > SMALL) & (F.col("class") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct(), "hubs")
    candidates = materialize(_sketch_filter(pairs.unionByName(hubs).distinct(), classes, limit), "candidates")
    large = hubs.limit(1).count() > 0
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("class"))
    if large:
        wanted = wanted.unionByName(hubs.select(F.explode(F.array("a", "b")).alias("class")))
    sets = materialize(_shingle_table(docs, id_col, text, classes.join(wanted.distinct(), "class", "left_semi")), "sets")
    links = materialize(_verified(candidates, sets, limit), "links")
    if large:
        links = links.unionByName(_group_links(hubs, links, classes, sets, limit))
    joined = components(links, "components").join(classes.select(F.col("class").alias("node"), "id"), "node")
    least = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    named = joined.join(least, "component").select(F.col("node").alias("class"), "component_id")
    # One row for each class on the right; adaptive execution splits the rows of a hot class on the left.
    names = materialize(classes.select("class", F.col("id").alias("own")).join(named, "class", "left")
                        .select(F.col("class").alias("c"), F.coalesce("component_id", "own").alias("component_id")), "names")
    linked = full.select("id", "n", "class").join(names, F.col("class") == F.col("c")).select("id", "n", "component_id")
    alone = all_marks.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                                            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
