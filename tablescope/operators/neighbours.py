"""Exact k-nearest-neighbour join over a distributed k-d partition tree.

Rows enter as distinct numeric vectors with a count, so copies never multiply
the work. Donor vectors of one group and one pattern of nulls are split at the
median of their widest feature, again and again, until a cell holds few enough.
A pass splits by up to three features of like width at once; it is two
aggregates and a join with the medians, so the depth follows the row count and
nothing is gathered.

A query first visits its home, the nearest cells that hold enough donors. The
k-th distance found there is its radius: after that it visits just the cells
whose box is not farther. That loses no neighbour, and the number of cells
within the radius does not grow with the table. Boxes are searched from the top:
a bounded number of upper boxes sits in every task, and the cells below an upper
box meet the queries that reach it in co-grouped blocks. A cell or a set of
queries of any size is cut into blocks of bounded size, each block keeps its k
best per query, and the block results are merged.

Distances are NaN-Euclidean: squared differences over the features present on
both sides, scaled by all / shared features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

CELL_ROWS = 1_000           # distinct donor vectors of a cell at most
AT_ONCE = 3                 # features split by one pass over the rows
MAX_CELLS = 4_096           # upper boxes held by a task; more of them are joined in blocks
BLOCK_BOXES = 4_096
BLOCK_DONORS = 8_192
BLOCK_QUERIES = 2_048


def vector(columns: list[Column]) -> Column:
    """Doubles with -0.0 folded, as one array column."""
    return F.array(*[c.cast("double") + F.lit(0.0) for c in columns])


def _mask(v: Column, p: int) -> Column:
    return F.concat(*[F.when(F.get(v, F.lit(i)).isNull(), F.lit("0")).otherwise(F.lit("1")) for i in range(p)])


def _boxes(placed: DataFrame, p: int, *more: str) -> DataFrame:
    at = lambda i: F.get("x", F.lit(i))
    return placed.groupBy("cell", "grp", *more).agg(
        F.sum("cnt").alias("rows"), F.count("*").alias("vectors"),
        F.array(*[F.min(at(i)) for i in range(p)]).alias("lo"),
        F.array(*[F.max(at(i)) for i in range(p)]).alias("hi"))


def _cell() -> Column:
    return F.concat_ws("|", "path", "family")


def _tree(donors: DataFrame, p: int, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """``donors`` with their cell, and the boxes of the cells (cell, grp, family, path, rows, vectors, lo, hi).

    A cell's name is its path through the splits and its family, the null pattern
    and the group. A split sorts values below, at and above the median apart, so
    one value that fills a feature becomes a part of its own and every split makes
    parts that are smaller or narrower. Features less than half as wide as the widest wait for their turn.
    """
    placed = donors.withColumn("family", F.concat_ws("|", _mask(F.col("x"), p), F.col("grp"))).withColumn("path", F.lit("")).withColumn("cell", _cell())
    while True:
        boxes = materialize(_boxes(placed, p, "family", "path"), "knn-boxes")
        widths = F.transform(F.arrays_zip("lo", "hi"), lambda b: F.coalesce(b["hi"] - b["lo"], F.lit(-1.0)))
        widest = F.array_sort(F.transform(widths, lambda w, i: F.struct((-w).alias("w"), i.alias("i"))))
        wanted = F.least(F.lit(AT_ONCE), F.ceil(F.log2(F.col("vectors") / cell_rows)).cast("int"))
        dims = F.transform(F.filter(F.slice(widest, F.lit(1), wanted), lambda d: d["w"] * 2 <= F.get(widest, F.lit(0))["w"]), lambda d: d["i"])
        full = boxes.where(F.col("vectors") > cell_rows).select(F.col("cell").alias("node"), dims.alias("dims"))
        if not full.limit(1).count():
            return placed, boxes
        value = lambda i: F.get("x", F.get("dims", F.lit(i)))
        middles = [F.percentile_approx(value(i), 0.5, 1000).alias(f"cut{i}") for i in range(AT_ONCE)]
        cuts = materialize(placed.join(full, F.col("cell") == F.col("node")).groupBy("node", "dims").agg(*middles), "knn-cuts")
        side = lambda i: F.coalesce((value(i) >= F.col(f"cut{i}")).cast("int") + (value(i) > F.col(f"cut{i}")).cast("int"), F.lit(0)) * 3 ** i
        part = sum((side(i) for i in range(1, AT_ONCE)), side(0))
        path = F.when(F.col("node").isNotNull(), F.concat("path", F.lit("."), part.cast("string"))).otherwise(F.col("path"))
        placed = materialize(placed.join(cuts, F.col("cell") == F.col("node"), "left").withColumn("path", path).withColumn("cell", _cell())
                             .select(*placed.columns), "knn-placed")


def _uppers(boxes: DataFrame, p: int, most: int) -> tuple[DataFrame, list | None, DataFrame]:
    """``boxes`` with their ``upper`` box, the uppers as rows (None where there are more than ``most``), and the uppers.

    Uppers are the cells themselves if these are few, else their ancestors at the deepest level with few enough nodes.
    """
    depth = boxes.agg(F.max(F.size(F.split("path", r"\.")))).first()[0] or 1
    while True:
        upper = F.concat_ws("|", F.substring_index("path", ".", depth), "family")
        with_upper = boxes.withColumn("upper", upper)
        at = lambda side, i: F.get(side, F.lit(i))
        uppers = with_upper.groupBy(F.col("upper").alias("cell"), "grp").agg(
            F.sum("rows").alias("rows"), F.array(*[F.min(at("lo", i)) for i in range(p)]).alias("lo"),
            F.array(*[F.max(at("hi", i)) for i in range(p)]).alias("hi"))
        rows = uppers.limit(most + 1).collect()
        if len(rows) <= most or depth == 1:
            return with_upper, rows if len(rows) <= most else None, uppers
        depth -= 1


def _as_matrix(values, p: int) -> np.ndarray:
    if len(values) == 0:
        return np.empty((0, p))
    return np.array([[np.nan if e is None else e for e in v] for v in values], dtype=float)


def _squared(q: np.ndarray, x: np.ndarray, p: int) -> np.ndarray:
    """All NaN-Euclidean squared distances of a bounded block, features in order."""
    total = np.zeros((len(q), len(x)))
    shared = np.zeros((len(q), len(x)))
    for f in range(p):
        diff = q[:, f, None] - x[None, :, f]
        both = ~np.isnan(diff)
        total += np.where(both, diff * diff, 0.0)
        shared += both
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, total * (p / shared), np.inf)


class _Bounds:
    """Cell boxes in arrays, and bounds of the distance of queries to them."""

    def __init__(self, boxes: list, p: int):
        self.p = p
        self.names = np.array([b["cell"] for b in boxes], dtype=object)
        self.groups = np.array([b["grp"] for b in boxes], dtype=object)
        self.rows = np.array([b["rows"] for b in boxes], dtype=float)
        self.lo, self.hi = _as_matrix([b["lo"] for b in boxes], p), _as_matrix([b["hi"] for b in boxes], p)

    def of(self, part: pd.DataFrame):
        """(usable, lower, upper) of each query and box."""
        p, lo, hi = self.p, self.lo, self.hi
        q = _as_matrix(part["q"].tolist(), p)
        target = part["target"].to_numpy()
        gap = np.zeros((len(q), len(lo)))
        far = np.zeros((len(q), len(lo)))
        shared = np.zeros((len(q), len(lo)))
        for f in range(p):
            below, above = lo[None, :, f] - q[:, f, None], q[:, f, None] - hi[None, :, f]
            both = ~np.isnan(below)
            near = np.maximum(np.maximum(below, above), 0.0)
            wide = np.maximum(np.abs(below), np.abs(above))
            gap += np.where(both, near * near, 0.0)
            far += np.where(both, wide * wide, 0.0)
            shared += both
        usable = (shared > 0) & (self.groups[None, :] == part["grp"].to_numpy(dtype=object)[:, None])
        for t in set(target.tolist()):
            if t >= 0:
                usable[target == t] &= ~np.isnan(lo[:, t])[None, :]
        scale = np.where(shared > 0, p / np.maximum(shared, 1), 1.0)
        return usable, np.where(usable, gap * scale, np.inf), np.where(usable, far * scale, np.inf)

    def nearest_first(self, usable: np.ndarray, upper: np.ndarray):
        """Boxes by upper bound, and the rows up to and with each."""
        order = np.argsort(upper, axis=1)
        return order, np.cumsum(np.where(np.take_along_axis(usable, order, 1), self.rows[order], 0.0), axis=1)

    def within(self, part: pd.DataFrame, usable: np.ndarray, lower: np.ndarray, limit: np.ndarray) -> pd.DataFrame:
        return self.pairs(part, *np.nonzero(usable & (lower <= limit * (1 + 1e-9) + 1e-300)))

    def pairs(self, part: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"q": part["q"].to_numpy(dtype=object)[i], "target": part["target"].to_numpy()[i], "grp": part["grp"].to_numpy(dtype=object)[i],
                             "limit": part["limit"].to_numpy()[i], "cell": self.names[j]})


PAIRS = "q array<double>, target int, grp string, limit double, cell string"


def _some(pdf: pd.DataFrame):
    return (pdf.iloc[start:start + 64] for start in range(0, len(pdf), 64))


def _home(bounds: _Bounds, part: pd.DataFrame, needed: int) -> pd.DataFrame:
    """The fewest boxes, by upper bound, that hold ``needed`` rows; all of them where there are fewer."""
    usable, _, upper = bounds.of(part)
    order, reach = bounds.nearest_first(usable, upper)
    rows = np.where(np.take_along_axis(usable, order, 1), bounds.rows[order], 0.0)
    i, j = np.nonzero((rows > 0) & (reach - rows < needed))
    return bounds.pairs(part, i, order[i, j])


def _reached(bounds: _Bounds, part: pd.DataFrame, needed: int) -> pd.DataFrame:
    """The boxes within the radius of each query."""
    usable, lower, _ = bounds.of(part)
    return bounds.within(part, usable, lower, part["limit"].to_numpy()[:, None])


def _among(boxes: list, p: int, needed: int, choose):
    """Row batches of queries to the pairs that ``choose`` makes of them and a bounded number of boxes."""
    bounds = _Bounds(boxes, p)

    def run(batches):
        for pdf in batches:
            out = [choose(bounds, part, needed) for part in _some(pdf)]
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def _below(p: int, needed: int, choose):
    """The same for one block of queries and the boxes of one block."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        frames = [_NO_PAIRS]
        if len(left) and len(right):
            bounds = _Bounds(right.to_dict("records"), p)
            frames += [choose(bounds, part, needed) for part in _some(left)]
        return pd.concat(frames[1:] or frames, ignore_index=True)

    return run


def _block_reach(p: int, needed: int):
    """The boxes of one block that a query needs, by upper bound, to be sure of ``needed`` rows."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        frames = [_NO_REACH]
        if len(left) and len(right):
            bounds = _Bounds(right.to_dict("records"), p)
            for part in _some(left):
                usable, _, upper = bounds.of(part)
                order, reach = bounds.nearest_first(usable, upper)
                sorted_rows = np.where(np.take_along_axis(usable, order, 1), bounds.rows[order], 0.0)
                i, j = np.nonzero((sorted_rows > 0) & (reach - sorted_rows < needed))
                frames.append(pd.DataFrame({
                    "q": part["q"].to_numpy(dtype=object)[i], "target": part["target"].to_numpy()[i], "grp": part["grp"].to_numpy(dtype=object)[i],
                    "upper": upper[i, order[i, j]], "rows": sorted_rows[i, j].astype("int64")}))
        return pd.concat(frames[1:] or frames, ignore_index=True)

    return run


_NO_PAIRS = pd.DataFrame({"q": pd.Series(dtype=object), "target": pd.Series(dtype="int32"), "grp": pd.Series(dtype=object),
                          "limit": pd.Series(dtype=float), "cell": pd.Series(dtype=object)})
_NO_REACH = pd.DataFrame({"q": pd.Series(dtype=object), "target": pd.Series(dtype="int32"), "grp": pd.Series(dtype=object),
                          "upper": pd.Series(dtype=float), "rows": pd.Series(dtype="int64")})


class _Blocks:
    """Queries and any number of boxes in bounded blocks of their group."""

    def __init__(self, queries: DataFrame, boxes: DataFrame, p: int, block_boxes: int, block_queries: int):
        self.boxes, self.p = boxes, p
        sizes = (queries.groupBy("grp").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("q_blocks"))
                 .join(boxes.groupBy("grp").agg(F.ceil(F.count("*") / block_boxes).cast("int").alias("b_blocks")), "grp"))
        self.sizes = materialize(sizes, "knn-box-blocks")

    def met(self, asked: DataFrame, run, ddl: str) -> DataFrame:
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        keys = ["grp", "b_block", "q_block"]
        left = (asked.join(self.sizes, "grp").withColumn("q_block", F.pmod(F.xxhash64("q", "target"), F.col("q_blocks")).cast("int"))
                .withColumn("b_block", spread("b_blocks")).drop("q_blocks", "b_blocks"))
        right = (self.boxes.join(self.sizes, "grp").withColumn("b_block", F.pmod(F.xxhash64("cell"), F.col("b_blocks")).cast("int"))
                 .withColumn("q_block", spread("q_blocks")).drop("q_blocks", "b_blocks"))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, ddl)

    def radius(self, queries: DataFrame, needed: int) -> DataFrame:
        """``queries`` plus ``limit``, the distance within which the boxes make ``needed`` rows certain."""
        reach = self.met(queries, _block_reach(self.p, needed), "q array<double>, target int, grp string, upper double, rows bigint")
        so_far = F.sum("rows").over(Window.partitionBy("q", "target", "grp").orderBy("upper").rowsBetween(Window.unboundedPreceding, 0))
        return (reach.withColumn("so_far", so_far).groupBy("q", "target", "grp")
                .agg(F.coalesce(F.min(F.when(F.col("so_far") >= needed, F.col("upper"))), F.lit(float("inf"))).alias("limit")))


def meet(pairs: DataFrame, items: DataFrame, key: str, run, ddl: str, block_pairs: int, block_items: int, pair_by: Column, item_by: Column) -> DataFrame:
    """``run`` on bounded blocks of the pairs and items that share ``key``: every pair meets every item, in blocks by the hashes given."""
    sizes = pairs.groupBy(key).agg(F.count("*").alias("asked")).join(items.groupBy(key).agg(F.count("*").alias("held")), key)
    blocks = materialize(sizes.select(key, F.ceil(F.col("asked") / block_pairs).cast("int").alias("q_blocks"),
                                      F.ceil(F.col("held") / block_items).cast("int").alias("d_blocks")), "blocks")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (pairs.join(blocks, key).withColumn("q_block", F.pmod(pair_by, F.col("q_blocks")).cast("int"))
            .withColumn("d_block", spread("d_blocks")).drop("q_blocks", "d_blocks"))
    right = (items.join(blocks, key).withColumn("d_block", F.pmod(item_by, F.col("d_blocks")).cast("int"))
             .withColumn("q_block", spread("q_blocks")).drop("q_blocks", "d_blocks"))
    keys = [key, "d_block", "q_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, ddl)


def _block_best(p: int, k: int, own: bool):
    """k best donors per query of one bounded block."""
    keep = k + (1 if own else 0)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        frames = []
        if len(left) and len(right):
            x_all = _as_matrix(right["x"].tolist(), p)
            counts = right["cnt"].to_numpy()
            for t, part in left.groupby("target"):
                order = np.argsort(x_all[:, t], kind="stable") if t >= 0 else np.lexsort(x_all.T[::-1])
                if t >= 0:
                    order = order[~np.isnan(x_all[order, t])]
                x, cnt = x_all[order], counts[order]
                vectors = right["x"].to_numpy(dtype=object)[order]
                if not len(x):
                    continue
                q = _as_matrix(part["q"].tolist(), p)
                dist = _squared(q, x, p)
                best = np.argsort(dist, axis=1, kind="stable")[:, :keep]
                d = np.take_along_axis(dist, best, 1)
                i, j = np.nonzero(np.isfinite(d))
                pick = best[i, j]
                frames.append(pd.DataFrame({
                    "q": part["q"].to_numpy(dtype=object)[i], "target": int(t), "grp": part["grp"].to_numpy(dtype=object)[i],
                    "x": vectors[pick], "dist": d[i, j], "cnt": cnt[pick]}))
        if frames:
            return pd.concat(frames, ignore_index=True)
        lists, texts = pd.Series(dtype=object), pd.Series(dtype=object)
        return pd.DataFrame({"q": lists, "target": pd.Series(dtype="int32"), "grp": texts, "x": lists,
                             "dist": pd.Series(dtype=float), "cnt": pd.Series(dtype="int64")})

    return run


class Search:
    """A k-d tree over ``donors`` and what its searches need; ``home`` and ``reached`` give (query, cell) pairs."""

    def __init__(self, donors: DataFrame, p: int, k: int, own: bool, cell_rows: int, block_donors: int, block_queries: int, block_boxes: int):
        self.p, self.k, self.own, self.needed = p, k, own, k + (1 if own else 0)
        self.block_donors, self.block_queries, self.block_boxes = block_donors, block_queries, block_boxes
        self.placed, boxes = _tree(donors, p, cell_rows)
        self.boxes, self.top, self.uppers = _uppers(boxes, p, MAX_CELLS)
        self.deep = self.boxes.where("cell <> upper").limit(1).count() > 0
        self.blocks: _Blocks | None = None

    def _pairs(self, queries: DataFrame, choose) -> DataFrame:
        if self.top is not None:
            found = queries.mapInPandas(_among(self.top, self.p, self.needed, choose), PAIRS)
        else:
            found = self.blocks.met(queries, _below(self.p, self.needed, choose), PAIRS)
        if not self.deep:
            return materialize(found, "knn-pairs")
        found = materialize(found.withColumnRenamed("cell", "upper"), "knn-uppers")
        return materialize(meet(found, self.boxes, "upper", _below(self.p, self.needed, choose), PAIRS, self.block_queries, self.block_boxes,
                                F.xxhash64("q", "target"), F.xxhash64("cell")), "knn-pairs")

    def home(self, queries: DataFrame) -> DataFrame:
        return self._pairs(queries.withColumn("limit", F.lit(float("inf"))), _home)

    def reached(self, limits: DataFrame) -> DataFrame:
        return self._pairs(limits, _reached)

    def visit(self, pairs: DataFrame) -> DataFrame:
        """(q, target, grp, x, dist, cnt): the best donors of each visited block; with ``own`` without the query's own copy."""
        best = meet(pairs, self.placed.select("cell", "grp", "x", "cnt"), "cell", _block_best(self.p, self.k, self.own),
                    "q array<double>, target int, grp string, x array<double>, dist double, cnt bigint", self.block_queries, self.block_donors,
                    F.xxhash64("q", "target"), F.xxhash64("x"))
        if self.own:
            best = best.withColumn("cnt", F.when(F.col("q").eqNullSafe(F.col("x")), F.col("cnt") - 1).otherwise(F.col("cnt"))).where(F.col("cnt") > 0)
        return best

    def radius(self, queries: DataFrame) -> DataFrame:
        """``queries`` plus ``limit``, the distance of the k-th donor at home, infinite where there are fewer. Where the families alone are
        more than a task holds, it is the distance that their boxes prove."""
        if self.top is None:
            self.blocks = _Blocks(queries, self.uppers, self.p, self.block_boxes, self.block_queries)
            return materialize(self.blocks.radius(queries, self.needed), "knn-radius")
        seen = self.visit(self.home(queries)).select("q", "target", "grp", "dist", "cnt")
        rows = seen.unionByName(queries.select("q", "target", "grp", F.lit(None).cast("double").alias("dist"), F.lit(0).cast("bigint").alias("cnt")))
        upto = F.sum("cnt").over(Window.partitionBy("q", "target", "grp").orderBy("dist").rowsBetween(Window.unboundedPreceding, 0))   # k a block
        return materialize(rows.withColumn("upto", upto).groupBy("q", "target", "grp").agg(
            F.coalesce(F.min(F.when(F.col("upto") >= self.k, F.col("dist"))), F.lit(float("inf"))).alias("limit")), "knn-radius")


def nearest(queries: DataFrame, donors: DataFrame, p: int, k: int, own: bool = False, cell_rows: int = CELL_ROWS,
            block_donors: int = BLOCK_DONORS, block_queries: int = BLOCK_QUERIES, block_boxes: int = BLOCK_BOXES) -> DataFrame:
    """(q, target, grp, x, dist, weight): the k nearest donor rows of each query.

    ``queries``: distinct (q array<double>, target int, grp string); ``target``
    is the feature a donor must have, or -1. ``donors``: distinct (x
    array<double>, grp string, cnt). Donors only serve queries of their group.
    ``dist`` is the squared distance, ``weight`` how many of the k neighbours
    are copies of ``x``; ties go to the smaller target value, then the smaller
    vector. With ``own`` the query is itself one of the donor rows and one copy
    of it is left out.
    """
    queries, donors = materialize(queries, "knn-queries"), materialize(donors, "knn-donors")      # both are read several times
    tree = Search(donors, p, k, own, cell_rows, block_donors, block_queries, block_boxes)
    best = tree.visit(tree.reached(tree.radius(queries)))
    value = F.when(F.col("target") >= 0, F.get("x", F.when(F.col("target") >= 0, F.col("target"))))
    order = Window.partitionBy("q", "target", "grp").orderBy("dist", value, "x")   # k rows per visited block
    before = F.coalesce(F.sum("cnt").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (best.withColumn("before", before).where(F.col("before") < k)
            .select("q", "target", "grp", "x", "dist", F.least(F.col("cnt"), F.lit(k) - F.col("before")).alias("weight")))
