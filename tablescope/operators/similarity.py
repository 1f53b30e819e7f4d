"""Exact top-k by cosine similarity, with blocks of vectors skipped by the triangle inequality.

Vectors of unit length are dealt to the nearest of some centres and, by their distance to it, to rings around the centre. For a query at
distance a of a centre no vector of a ring from r to R is nearer than a - R or r - a. A query first visits the rings at its own distance around its
nearest centre; the k-th similarity found there is its threshold, and only rings that the bound does not exclude are visited then. Centres are
fitted to a bounded sample, which decides how much is skipped and nothing else.

The second visit goes by cells, some neighbouring centres with about 1/BLOCKS of the vectors: a query is sent once to each cell that it reaches,
not once to each ring, and the task that holds the cell looks at the reached rings only. Of queries and cells of at most MOST_BLOCK
vectors a task holds one block each. So queries that reach everything cost BLOCKS copies of the tables, up to BLOCKS * MOST_BLOCK
vectors; beyond, where blocks stay as large, the copies grow with the table.

A vector without direction (null, of length zero, with a null or non-finite component, or of another dimension than most) has similarity 0 to
every other. Similarities that agree in nine digits are ties and go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import quoted
from ..session import local_table, materialize
from .neighbours import meet

MOST_CENTRES = 4_096
SAMPLE_PER_CENTRE = 10          # 40,960 sampled vectors at most
RING = 512                      # vectors of a ring, on average
BLOCK_VECTORS, BLOCK_QUERIES = 8_192, 1_024
BLOCKS = 12                     # blocks of vectors and of queries in the second visit, while none is above MOST_BLOCK
LEAST_BLOCK, MOST_BLOCK = 1_024, 65_536     # 33 MB with 64 dimensions
AT_ONCE = 1 << 21               # similarities or hits held at once, 16 MB
SLACK = 1e-8


def _unit(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, v): vectors of unit length, null where there is no direction."""
    v = quoted(vector_col).cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    fine = (F.size(v) == dim) & (size > 0) & (size < float("inf"))       # NaN is above infinity
    return df.select(quoted(id_col).alias("id"), F.when(fine, F.transform(v, lambda x: x / size)).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, dim)


def _fit(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """k-means on the sample; empty centres go."""
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)]
    for _ in range(rounds):
        own = np.argmax(sample @ centres.T - (centres ** 2).sum(1) / 2, axis=1)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = sums[count > 0] / count[count > 0, None]
    return centres


def _distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (v ** 2).sum(1)[:, None] + (centres ** 2).sum(1)[None, :] - 2 * (v @ centres.T)
    return np.sqrt(np.maximum(square, 0.0))


def _cells(centres: np.ndarray, held: np.ndarray, most: int) -> np.ndarray:
    """The cell of each centre: neighbours together, ``most`` vectors in a cell unless one centre has more."""
    order, todo = [], [np.arange(len(centres))]
    while todo:                 # halves along the widest dimension, nearest first
        part = todo.pop()
        if len(part) < 3:
            order += part.tolist()
            continue
        widest = np.argmax(np.ptp(centres[part], axis=0))
        part = part[np.argsort(centres[part, widest], kind="stable")]
        todo += [part[len(part) // 2:], part[:len(part) // 2]]
    cells, cell, size = np.zeros(len(centres), np.int32), 0, 0
    for c in order:
        if size and size + held[c] > most:
            cell, size = cell + 1, 0
        cells[c], size = cell, size + held[c]
    return cells


class _Best:
    """The ``k`` best (query, vector) of a block so far: hits gather until there are AT_ONCE, then only the best stay and ``floor`` rises."""

    def __init__(self, q: np.ndarray, x: np.ndarray, place: np.ndarray, k: int, floor: np.ndarray):
        self.q, self.x, self.place, self.k, self.floor = q, x, place, k, floor
        self.hits, self.n = [], 0
        self.i = self.j = np.zeros(0, np.int64)
        self.exact = np.zeros(0)

    def add(self, i: np.ndarray, j: np.ndarray, rough: np.ndarray) -> None:
        self.hits.append((i, j, rough))
        self.n += len(i)
        if self.n >= AT_ONCE:
            self.settle()

    def settle(self) -> None:
        i, j, rough = (np.concatenate([own, *more]) for own, *more in zip((self.i, self.j, self.exact), *self.hits))
        order = np.lexsort((-rough, i))
        i, j, rough = i[order], j[order], rough[order]
        start = np.searchsorted(i, i)
        last = start + self.k - 1                   # the k-th of each query, where it has as many
        last = np.where((last < len(i)) & (i[np.minimum(last, len(i) - 1)] == i), last, -1)
        near = (last < 0) | (rough >= rough[last] - SLACK)
        i, j = i[near], j[near]
        exact = np.zeros(len(i))
        for f in range(self.q.shape[1]):            # in one order, so that equal vectors have equal similarities
            exact += self.q[i, f] * self.x[j, f]
        exact = np.round(exact, 9)
        order = np.lexsort((self.place[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        full = rank == self.k - 1
        self.floor[i[full]] = np.maximum(self.floor[i[full]], exact[full])
        self.i, self.j, self.exact = i[rank < self.k], j[rank < self.k], exact[rank < self.k]
        self.hits, self.n = [], 0


class SimilarityIndex:
    """Documents in rings around centres; ``first`` and ``reached`` give the (query, ring) pairs of the two rounds."""

    def __init__(self, docs: DataFrame, id_col: str, vector_col: str, centres: int | None = None, ring: int = RING,
                 block_queries: int = BLOCK_QUERIES, block_vectors: int = BLOCK_VECTORS, block: int | None = None):
        self.block_queries, self.block_vectors = block_queries, block_vectors
        self.dim = docs.agg(F.mode(F.size(quoted(vector_col)))).first()[0] or 0
        self.kind = docs.schema[id_col].dataType.simpleString()
        units = _unit(docs, id_col, vector_col, self.dim)
        self.units = materialize(units.where("v is not null"), "units")
        self.aimless = units.where("v is null").select("id")
        n = self.units.count()
        wanted = centres or max(1, min(MOST_CENTRES, int(n ** 0.5)))
        order = F.xxhash64(F.lit("centres"), "v")
        sample = self.units.where(F.pmod(order, F.lit(max(1, n // (4 * SAMPLE_PER_CENTRE * wanted)))) == 0).orderBy(order, "id").limit(SAMPLE_PER_CENTRE * wanted)
        rows = sample.select("v").toArrow().column("v").combine_chunks()
        self.centres = _fit(_matrix(rows, self.dim), wanted) if len(rows) else np.zeros((0, self.dim))
        shared = self.units.sparkSession.sparkContext.broadcast(self.centres)       # MOST_CENTRES vectors at most
        dim = self.dim

        def deal(batches):
            for b in batches:
                v = _matrix(b.column("v"), dim)
                centre = np.argmin(_distances(v, shared.value), axis=1) if len(v) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(centre.astype(np.int32)),
                                                  pa.array(np.sqrt(((v - shared.value[centre]) ** 2).sum(1)))], names=["id", "v", "centre", "away"])

        placed = materialize(self.units.mapInArrow(deal, f"id {self.kind}, v array<double>, centre int, away double"), "dealt")
        spans = materialize(placed.groupBy("centre").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")), "spans")
        rings = F.ceil(F.col("n") / ring)
        at = F.when(F.col("high") > F.col("low"), F.least(rings - 1, F.floor((F.col("away") - F.col("low")) / (F.col("high") - F.col("low")) * rings))).otherwise(0)
        self.placed = materialize(placed.join(spans, "centre").withColumn("ring", F.concat_ws(".", "centre", at.cast("bigint")))
                                  .select("id", "v", "ring", "centre", "away"), "rings")
        self.rings = materialize(self.placed.groupBy("ring", "centre").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")), "ring-spans")
        self.spans = {r["centre"]: (r["n"], r["low"], r["high"]) for r in spans.collect()}      # MOST_CENTRES rows at most
        self.block = block or max(LEAST_BLOCK, min(MOST_BLOCK, -(-n // BLOCKS)))
        self.cells = _cells(self.centres, np.array([self.spans.get(i, (0, 0, 0))[0] for i in range(len(self.centres))], np.int64), self.block)

    def _centres(self, queries: DataFrame, choose) -> DataFrame:
        """(qid, v, reach, centre, apart) for the centres that ``choose`` (distances, reach -> mask) picks."""
        centres, dim = queries.sparkSession.sparkContext.broadcast(self.centres), self.dim
        kind = queries.schema["qid"].dataType.simpleString()

        def run(batches):
            for whole in batches:
                for start in range(0, whole.num_rows, 256):
                    b = whole.slice(start, 256)
                    d = _distances(_matrix(b.column("v"), dim), centres.value)
                    i, j = np.nonzero(choose(d, np.asarray(b.column("reach"))))
                    rows = pa.array(i)
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(rows) for c in ("qid", "v", "reach")], pa.array(j.astype(np.int32)), pa.array(d[i, j])],
                                                     names=["qid", "v", "reach", "centre", "apart"])

        found = queries.mapInArrow(run, f"qid {kind}, v array<double>, reach double, centre int, apart double")
        gap = F.greatest(F.lit(0.0), F.col("apart") - F.col("high"), F.col("low") - F.col("apart"))
        return found.join(self.rings, "centre").withColumn("gap", gap)

    def first(self, queries: DataFrame, k: int) -> DataFrame:
        """The rings nearest to each query, around its nearest centres, that hold ``k`` vectors."""
        held = np.array([self.spans.get(i, (0, 0, 0))[0] for i in range(len(self.centres))])

        def nearest(d, _):
            order = np.argsort(d, axis=1)
            before = np.cumsum(held[order], axis=1) - held[order]
            mask = np.zeros(d.shape, bool)
            np.put_along_axis(mask, order, (before < k) & (held[order] > 0), axis=1)
            return mask

        around = self._centres(queries.withColumn("reach", F.lit(float("inf"))), nearest)
        before = F.sum("n").over(Window.partitionBy("qid").orderBy("gap", "ring")) - F.col("n")        # the rings of a few centres
        return around.withColumn("before", before).where(F.col("before") < k).select("qid", "v", "reach", "ring")

    def reached(self, queries: DataFrame) -> DataFrame:
        """The rings that the threshold of a query (``reach``, a distance) does not exclude."""
        low = np.array([self.spans.get(i, (0, np.inf, -np.inf))[1] for i in range(len(self.centres))])
        high = np.array([self.spans.get(i, (0, np.inf, -np.inf))[2] for i in range(len(self.centres))])
        near = lambda d, reach: np.maximum(d - high, low - d) <= reach[:, None] + SLACK      # noqa: E731
        return self._centres(queries, near).where(F.col("gap") <= F.col("reach") + SLACK).select("qid", "v", "reach", "ring")

    def visit(self, pairs: DataFrame, k: int) -> DataFrame:
        """(qid, id, similarity): the ``k`` best of each visited block of vectors."""
        kind = pairs.schema["qid"].dataType.simpleString()

        def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({"qid": a["qid"] if len(a) == 0 else a["qid"][:0], "id": b["id"][:0], "similarity": pd.Series(dtype=float)})
            b = b.sort_values("id", kind="stable")
            x, out = np.array(b["v"].tolist(), float), []
            for start in range(0, len(a), 128):
                q = np.array(a["v"][start:start + 128].tolist(), float)
                rough = q @ x.T
                least = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
                i, j = np.nonzero(rough >= least[:, None] - SLACK)
                exact = np.zeros(len(i))
                for f in range(q.shape[1]):      # in one order, so that equal vectors have equal similarities
                    exact += q[i, f] * x[j, f]
                exact = np.round(exact, 9)
                order = np.lexsort((j, -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                keep = place < k
                out.append(pd.DataFrame({"qid": a["qid"].to_numpy()[start + i[keep]], "id": b["id"].to_numpy()[j[keep]], "similarity": exact[keep]}))
            return pd.concat(out, ignore_index=True)

        return meet(pairs, self.placed.select("id", "v", "ring"), "ring", best, f"qid {kind}, id {self.kind}, similarity double",
                    self.block_queries, self.block_vectors, F.xxhash64("qid"), F.xxhash64("id"))

    def sweep(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, similarity): of all rings that the threshold of a query does not exclude, the ``k`` best of each block of vectors."""
        spark, kind, dim = queries.sparkSession, queries.schema["qid"].dataType.simpleString(), self.dim
        centres = spark.sparkContext.broadcast(self.centres)
        low = np.array([self.spans.get(i, (0, np.inf, -np.inf))[1] for i in range(len(self.centres))])
        high = np.array([self.spans.get(i, (0, np.inf, -np.inf))[2] for i in range(len(self.centres))])
        by_cell = np.argsort(self.cells, kind="stable")
        names, starts = np.unique(self.cells[by_cell], return_index=True)

        def send(batches):
            for whole in batches:
                for start in range(0, whole.num_rows, 256):
                    b = whole.slice(start, 256)
                    d = _distances(_matrix(b.column("v"), dim), centres.value)
                    near = np.maximum(d - high, low - d) <= np.asarray(b.column("reach"))[:, None] + SLACK
                    i, cell = np.nonzero(np.logical_or.reduceat(near[:, by_cell], starts, axis=1))
                    rows = pa.array(i)
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(rows) for c in ("qid", "v", "reach")], pa.array(names[cell])], names=["qid", "v", "reach", "cell"])

        def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({"qid": a["qid"][:0], "id": b["id"][:0], "similarity": pd.Series(dtype=float)})
            b = b.sort_values("ring", kind="stable")
            q, x, ids, away = np.array(a["v"].tolist(), float), np.array(b["v"].tolist(), float), b["id"].reset_index(drop=True), b["away"].to_numpy()
            place = np.empty(len(b), np.int64)
            place[ids.sort_values(kind="stable").index] = np.arange(len(b))         # of ties the smaller id
            reach, which = a["reach"].to_numpy(), b["centre"].to_numpy()
            found = _Best(q, x, place, k, 1 - reach ** 2 / 2)
            rings = b["ring"].to_numpy()
            first = np.concatenate([[0], np.flatnonzero(rings[1:] != rings[:-1]) + 1, [len(b)]])
            for at, end in zip(first[:-1].tolist(), first[1:].tolist()):
                apart = np.sqrt(((q - centres.value[which[at]]) ** 2).sum(1))
                who = np.flatnonzero(np.maximum(apart - away[at:end].max(), away[at:end].min() - apart) <= reach + SLACK)
                step = max(1, AT_ONCE // (end - at))
                for some in (who[s:s + step] for s in range(0, len(who), step)):
                    rough = q[some] @ x[at:end].T
                    i, j = np.nonzero(rough >= found.floor[some][:, None] - SLACK)
                    found.add(some[i], at + j, rough[i, j])
            if found.n:
                found.settle()
            return pd.DataFrame({"qid": a["qid"].to_numpy()[found.i], "id": ids.to_numpy()[found.j], "similarity": found.exact})

        sent = materialize(queries.select("qid", "v", "reach").mapInArrow(send, f"qid {kind}, v array<double>, reach double, cell int"), "sent")
        cells = local_table(spark, [{"c": i, "cell": int(c)} for i, c in enumerate(self.cells)], "c int, cell int")      # MOST_CENTRES rows at most
        held = self.placed.join(F.broadcast(cells), F.col("centre") == F.col("c")).select("id", "v", "ring", "centre", "away", "cell")
        return meet(sent, held, "cell", best, f"qid {kind}, id {self.kind}, similarity double", self.block, self.block, F.xxhash64("qid"), F.xxhash64("id"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")       # k rows a visited block
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, docs: DataFrame, k: int, query_id: str, doc_id: str, vector_col: str = "embedding", index: SimilarityIndex | None = None) -> DataFrame:
    """(query id, doc id, similarity, rank) for a table of queries; ids are of any type that sorts, and distinct."""
    index = index or SimilarityIndex(docs, doc_id, vector_col)
    asked = materialize(_unit(queries, query_id, vector_col, index.dim).withColumnRenamed("id", "qid"), "asked")
    aimed = asked.where("v is not null")
    seen = _ranked(index.visit(materialize(index.first(aimed, k), "first"), k), k)
    # A vector without direction is at similarity 0 to all, so k of them bound every threshold too.
    reach = seen.where(F.col("rank") == k).select(F.col("qid").alias("r"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))).alias("reach"))
    limits = aimed.join(materialize(reach, "thresholds"), F.col("qid") == F.col("r"), "left").select("qid", "v", F.coalesce("reach", F.lit(2.0)).alias("reach"))
    found = index.sweep(limits, k)
    first_ids = lambda df: [r["id"] for r in df.orderBy("id").limit(k).collect()]      # noqa: E731

    def zeros(who: DataFrame, ids: list) -> DataFrame:
        """Each query with ``k`` ids at most, at similarity 0."""
        listed = F.array(*[F.lit(i) for i in ids]).cast(f"array<{index.kind}>")
        return who.select("qid", F.explode(listed).alias("id"), F.lit(0.0).alias("similarity"))

    still, every = first_ids(index.aimless), first_ids(docs.select(quoted(doc_id).alias("id")))
    found = found.unionByName(zeros(aimed, still)).unionByName(zeros(asked.where("v is null"), every))
    return _ranked(found, k).select(F.col("qid").alias(query_id), F.col("id").alias(doc_id), "similarity", "rank")
