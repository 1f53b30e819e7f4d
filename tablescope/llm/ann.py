"""Nearest neighbours with a hierarchical k-means tree and best-bin-first traversal.

The tree is fitted on a bounded sample (``sample_rows``; the rows with the smallest hash) and holds centres only, so it is sent to
every task. Every vector is led down to its leaf and stored by leaf. A query takes leaves from a priority queue in order of distance
to their centres. How many it takes is calibrated: for ``calibration`` queries the true neighbours are found by comparing with all
rows, and the visits are widened until the leaves visited hold the wanted share of them. Leaves are compared in blocks of bounded size.

Vectors that are null, empty, zero, hold null or non-finite components, or have another dimension than most, take no part. Of rows
that repeat a query's id the smallest vector is the query, and none of them is its neighbour. Ties go to the smaller id. An empty
table gives an empty result; queries with fewer candidates than wanted get all.
Only the id and vector columns are read, so further columns change nothing, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

BRANCHES = 8
LEAF_SAMPLE = 64
BLOCK = 4096


@dataclass
class Tree:
    centres: list[np.ndarray] = field(default_factory=list)     # by node
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)               # leaf number or -1
    leaves: int = 0

    def _add(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.centres) - 1

    def grow(self, x: np.ndarray, draw: np.random.Generator, node: int | None = None) -> Tree:
        node = self._add(x.mean(axis=0)) if node is None else node
        parts = _split(x, draw) if len(x) > LEAF_SAMPLE else []
        if len(parts) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return self
        for part in parts:
            child = self._add(part.mean(axis=0))
            self.children[node].append(child)
            self.grow(part, draw, child)
        return self

    def assign(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            nearest = _distances(x[rows], np.stack([self.centres[k] for k in kids])).argmin(axis=1)
            todo += [(k, rows[nearest == i]) for i, k in enumerate(kids) if (nearest == i).any()]
        return out

    def leaves_by_distance(self, q: np.ndarray):
        """Leaf numbers, best bin first."""
        queue, n = [(0.0, 0, 0)], 0
        while queue:
            _, _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            kids = self.children[node]
            for d, k in zip(((np.stack([self.centres[k] for k in kids]) - q) ** 2).sum(axis=1), kids):
                n += 1
                heapq.heappush(queue, (float(d), n, k))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)


def _split(x: np.ndarray, draw: np.random.Generator, rounds: int = 12) -> list[np.ndarray]:
    """k-means into BRANCHES parts; parts without rows are left out."""
    centres = x[draw.choice(len(x), min(BRANCHES, len(x)), replace=False)]
    for _ in range(rounds):
        own = _distances(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    own = _distances(x, centres).argmin(axis=1)
    return [x[own == i] for i in range(len(centres)) if (own == i).any()]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _nearest(q: np.ndarray, own, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, distances) of the k nearest, nearest first, ties to the smaller id; rows with the query's id are left out."""
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    d[ids == own] = np.inf
    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
    near = near[np.isfinite(d[near])]
    near = near[np.lexsort((ids[near], d[near]))][:k]
    return near, d[near]


def usable(df: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part, and their dimension."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.where(F.exists("v", lambda x: x != 0))
    dim = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (dim[0]["d"] if dim else 1)), dim[0]["d"] if dim else 1


def search(df: DataFrame, queries: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, recall: float = 0.97,
           sample_rows: int = 20_000, calibration: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row where ``queries``, a condition on ``id``, holds."""
    spark = df.sparkSession
    rows, dim = usable(df, id_col, vector)
    vectors = T.StructType().add("id", "long").add("v", T.ArrayType(T.DoubleType()))
    ask = rows.where(queries).groupBy("id").agg(F.min("v").alias("v"))
    order = lambda salt: (F.xxhash64(F.lit(salt), "id"), F.col("id"))       # noqa: E731
    sample = rows.orderBy(*order("fit")).limit(min(sample_rows, max(1000, (1 << 25) // (8 * dim)))).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree().grow(_matrix(sample.column("v").combine_chunks(), dim), np.random.default_rng(5))
    shared = spark.sparkContext.broadcast(tree)     # at most sample_rows / 8 centres

    def place(batches):
        for b in batches:
            leaf = shared.value.assign(_matrix(b.column("v"), dim)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(leaf)], names=["id", "v", "leaf"])

    index = materialize(rows.mapInArrow(place, T.StructType([*vectors.fields]).add("leaf", "long")), "leaves")
    counts = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}       # one row for each leaf of the tree
    visits = _calibrated(index, ask.orderBy(*order("calibrate")).limit(calibration), tree, dim, k, recall)

    def bins(batches):
        for b in batches:
            found, leaves = [], []
            for i, q in enumerate(_matrix(b.column("v"), dim) if b.num_rows else ()):
                held = n = 0
                for leaf in shared.value.leaves_by_distance(q):
                    found.append(i)
                    leaves.append(leaf)
                    held, n = held + counts.get(leaf, 0), n + 1
                    if n >= visits and held >= 10 * k:
                        break
            at = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("v").take(at), pa.array(leaves, pa.int64())], names=["id", "v", "leaf"])

    wanted = materialize(ask.mapInArrow(bins, T.StructType([*vectors.fields]).add("leaf", "long")), "visits")
    asked = {r["leaf"]: r["count"] for r in wanted.groupBy("leaf").count().collect()}
    blocks = spark.createDataFrame([(leaf, -(-n // BLOCK), -(-asked[leaf] // BLOCK)) for leaf, n in counts.items() if leaf in asked] or [(-1, 1, 1)],
                                   "at long, parts long, ask_parts long")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))      # noqa: E731
    pick = lambda n: F.pmod(F.xxhash64("id"), F.col(n))     # noqa: E731
    dealt = lambda t: t.join(F.broadcast(blocks), F.col("leaf") == F.col("at"))     # noqa: E731  one row for each leaf
    left = dealt(wanted).select("id", "v", "leaf", spread("parts").alias("part"), pick("ask_parts").alias("ask_part"))
    right = dealt(index).select("id", "v", "leaf", pick("parts").alias("part"), spread("ask_parts").alias("ask_part"))
    keys = ["leaf", "part", "ask_part"]

    def compare(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x, ids, out = np.stack(held.v.to_numpy()), held.id.to_numpy(), []
        for own, q in zip(asking.id, asking.v):
            near, d = _nearest(np.asarray(q), own, x, ids, k)
            out.append(pd.DataFrame({"query_id": own, "vec_id": ids[near], "score": d}))
        return pd.concat(out)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")        # k rows for each block that a query visits
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def true_neighbours(index: DataFrame, ask: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, leaf), exactly: a bounded set of queries against all rows, each task keeping k for each query."""
    few = ask.toArrow()
    shared = index.sparkSession.sparkContext.broadcast((np.asarray(few.column("id")), _matrix(few.column("v").combine_chunks(), dim)))

    def run(batches):
        own, q = shared.value
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(own)
        for b in batches:
            x, ids, leaf = _matrix(b.column("v"), dim), np.asarray(b.column("id")), np.asarray(b.column("leaf"))
            for i in range(len(own)):
                near, d = _nearest(q[i], own[i], x, ids, k)
                d, n, at = (np.concatenate(z) for z in zip(best[i], (d, ids[near], leaf[near])))
                keep = np.lexsort((n, d))[:k]
                best[i] = d[keep], n[keep], at[keep]
        size = [len(z[0]) for z in best]
        d, n, at = (np.concatenate([z[j] for z in best]) for j in range(3)) if len(best) else (np.zeros(0),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, size), pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.float64()), pa.array(at, pa.int64())],
                                         names=["query_id", "vec_id", "score", "leaf"])

    found = index.select("id", "v", "leaf").mapInArrow(run, "query_id long, vec_id long, score double, leaf long")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _calibrated(index: DataFrame, ask: DataFrame, tree: Tree, dim: int, k: int, recall: float) -> int:
    """The leaf visits at which the calibration queries find ``recall`` of their true neighbours."""
    ask = materialize(ask, "calibration")
    if not ask.limit(1).count():
        return 1
    few = ask.toArrow()
    place = {own: {leaf: i for i, leaf in enumerate(tree.leaves_by_distance(q))}
             for own, q in zip(few.column("id").to_pylist(), _matrix(few.column("v").combine_chunks(), dim))}
    needed = np.array([place[r["query_id"]][r["leaf"]] + 1 for r in true_neighbours(index, ask, dim, k).collect()])     # k for each query
    visits = 1
    while len(needed) and (needed <= visits).mean() < recall:
        visits += max(1, visits // 8)
    return visits
