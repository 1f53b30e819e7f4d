"""A decision tree by histograms: each level is one grouped count of (node, column, bin) and one window over the bins.

Numbers fall into bins of equal width between the smallest and largest training value; a split puts the bins up to one of them to the
left. Texts fall into buckets by md5, whatever the number of their values; a split puts one bucket to the left. The bins are written once, a byte for
each column, and a level reads those. What is shuffled are counts by node, column, bin and class, combined in each task, so
neither a hot value nor the number of rows matters; the driver sees one split for each node.

The best split is the one of largest gain (sum of squares over size, the Gini gain for classes and the fall of variance for numbers), rounded to
six decimals; ties go to the earlier column and the smaller bin. Rows with a null in any column are left out. Constant columns never
split; a table without rows has no leaves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import fold_nan, is_numeric, is_text, quoted, rounded
from ..session import materialize
from .split import assign_split

BINS = 32       # below 128: a bin is stored as one byte


def _bin(column: str, low: float | None, high: float | None, bins: int) -> Column:
    """The bin of a value; ``low`` and ``high`` are null for a text."""
    if low is None:
        at = F.conv(F.substring(F.md5(quoted(column).cast("binary")), 1, 4), 16, 10).cast("int") % bins
    elif high > low:
        place = F.floor((quoted(column).cast("double") - F.lit(low)) / F.lit(high - low) * bins)
        at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), place))
    else:
        at = F.lit(0)
    return at.cast("tinyint")


@dataclass
class Tree:
    target: str
    classify: bool
    columns: list[str]
    limits: dict[str, tuple[float | None, float | None]]        # (None, None) for a text
    bins: int
    splits: dict[int, tuple[int, int]] = field(default_factory=dict)    # node: (position of the column, bin)
    leaves: DataFrame | None = None                                     # (node, rows, prediction)

    def text(self, i: int) -> bool:
        return self.limits[self.columns[i]][0] is None

    def binned(self, prefix: str = "b") -> list[Column]:
        return [_bin(c, *self.limits[c], self.bins).alias(f"{prefix}{i}") for i, c in enumerate(self.columns)]

    def node(self, prefix: str = "b", at: int = 1) -> Column:
        """The leaf of a row with columns b0, b1, ... (see ``binned``)."""
        if at not in self.splits:
            return F.lit(at)
        i, b = self.splits[at]
        left = F.col(f"{prefix}{i}") == b if self.text(i) else F.col(f"{prefix}{i}") <= b
        return F.when(left, self.node(prefix, 2 * at)).otherwise(self.node(prefix, 2 * at + 1))

    def rules(self) -> list[dict]:
        """One row for each split: node, column, the values to the left."""
        out = []
        for node, (i, b) in sorted(self.splits.items()):
            low, high = self.limits[self.columns[i]]
            rule = f"bucket {b}" if low is None else f"below {low + (high - low) * (b + 1) / self.bins:g}"
            out.append({"node": node, "column": self.columns[i], "bin": b, "rule": rule})
        return out

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` (its complete rows) plus the prediction; one row a leaf is joined."""
        kept, own, leaf = complete(df, self.columns), [quoted(c) for c in df.columns], self.leaves
        placed = kept.select(*own, *self.binned("_tree_b")).select(*own, self.node("_tree_b").alias("_tree_node"))
        known = leaf.select(F.col("node").alias("_tree_node"), F.col("prediction").alias(name))
        return placed.join(F.broadcast(known), "_tree_node").drop("_tree_node")       # 2 ** depth rows at most


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return fold_nan(df).na.drop("any", subset=columns) if columns else df


def usable(df: DataFrame, leave_out: list[str]) -> list[str]:
    """The columns a tree can split on: numbers and texts."""
    return [f.name for f in df.schema.fields if f.name not in leave_out and (is_numeric(f) or is_text(f))]


def _best(cells: DataFrame, tree: Tree, min_rows: int) -> dict[int, tuple[int, int]]:
    """The best split of each node of ``cells`` (node, f, b, cls, k, s)."""
    text = F.array(*[F.lit(tree.text(i)) for i in range(len(tree.columns))])
    totals = cells.groupBy("node", "f", "cls").agg(F.sum("k").alias("all_k"), F.sum("s").alias("all_s"))
    grid = cells.select("node", "f", "b").distinct().join(totals, ["node", "f"]).join(cells, ["node", "f", "b", "cls"], "left")
    upto = Window.partitionBy("node", "f", "cls").orderBy("b")          # a row for each bin
    for c in ("k", "s"):
        own = F.coalesce(c, F.lit(0))
        grid = grid.withColumn("left_" + c, F.when(text[F.col("f")], own).otherwise(F.sum(own).over(upto)))
    square = lambda x: F.sum(x.cast("double") * x.cast("double"))     # noqa: E731
    rest = F.col("all_k") - F.col("left_k")
    sides = grid.groupBy("node", "f", "b").agg(
        F.sum("left_k").alias("n_left"), F.sum(rest).alias("n_right"), square(F.col("left_s")).alias("q_left"),
        square(F.col("all_s") - F.col("left_s")).alias("q_right"), square(F.col("all_s")).alias("q"))
    gain = (F.col("q_left") / F.col("n_left") + F.col("q_right") / F.col("n_right")) - F.col("q") / (F.col("n_left") + F.col("n_right"))
    fit = sides.where((F.col("n_left") >= min_rows) & (F.col("n_right") >= min_rows)).withColumn("gain", rounded(gain, 6)).where("gain > 0")
    best = fit.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("less"), "f", "b")).alias("best"))
    return {r["node"]: (r["best"]["f"], r["best"]["b"]) for r in best.collect()}        # a row for each node


def fit_tree(df: DataFrame, target: str, columns: list[str] | None = None, classify: bool = True, depth: int = 3, bins: int = BINS,
             min_rows: int = 5) -> Tree:
    """Learn a tree of at most ``depth`` levels of splits; both sides of a split hold ``min_rows`` rows or more."""
    if not 1 <= bins < 128:
        raise ValueError("bins must be from 1 to 127")
    columns = usable(df, [target]) if columns is None else columns
    df = complete(df, [target, *columns])
    numbers = [c for c in columns if is_numeric(df.schema[c])]
    ends = [f(quoted(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(numbers) for n, f in (("low", F.min), ("high", F.max))]
    row = df.agg(F.count("*").alias("n"), *ends).first()
    empty = row["n"] == 0
    limits = {c: (None, None) for c in columns}
    limits.update({c: (0.0, 0.0) if empty else (row[f"low{i}"], row[f"high{i}"]) for i, c in enumerate(numbers)})
    tree = Tree(target, classify, columns, limits, bins)
    label, weight = (quoted(target).cast("string"), F.lit(1)) if classify else (F.lit(""), quoted(target).cast("double"))
    rows = materialize(df.select(label.alias("cls"), weight.alias("w"), *tree.binned()), "tree")
    for level in range(depth if columns else 0):
        nodes = rows.withColumn("node", tree.node()).where(F.col("node") >= 1 << level)
        long = nodes.select("node", "cls", "w", F.posexplode(F.array(*[F.col(f"b{i}") for i in range(len(columns))])).alias("f", "b"))
        cells = materialize(long.groupBy("node", "f", "b", "cls").agg(F.count("*").alias("k"), F.sum("w").alias("s")), "cells")
        found = _best(cells, tree, min_rows)
        if not found:
            break
        tree.splits.update(found)
    counts = rows.withColumn("node", tree.node()).groupBy("node", "cls").agg(F.count("*").alias("k"), F.sum("w").alias("s"))
    value = F.min(F.struct((-F.col("k")).alias("less"), "cls"))["cls"] if classify else F.sum("s") / F.sum("k")
    tree.leaves = materialize(counts.groupBy("node").agg(F.sum("k").alias("rows"), value.alias("prediction")), "leaves")
    return tree


def baseline_tree(df: DataFrame, target: str, key: list[str] | str, classify: bool = True, depth: int = 3, bins: int = BINS, min_rows: int = 5,
                  columns: list[str] | None = None, seed: int = 42) -> DataFrame:
    """One row for each leaf of a tree learnt from four fifths of the complete rows: (node, rows, prediction, test_rows, and for the
    fifth set aside ``test_hits``, or ``test_error``, the sum of absolute errors)."""
    keys = [key] if isinstance(key, str) else list(key)
    columns = usable(df, [target, *keys]) if columns is None else columns
    both = assign_split(complete(df, [target, *columns]), keys, seed=seed)
    tree = fit_tree(both.where("split = 'train'"), target, columns, classify, depth, bins, min_rows)
    placed = both.where("split = 'test'").select(quoted(target).alias("was"), *tree.binned()).select("was", tree.node().alias("node"))
    joined = placed.join(F.broadcast(tree.leaves.select("node", "prediction")), "node")
    measure = (F.sum((F.col("was").cast("string") == F.col("prediction")).cast("bigint")).alias("test_hits") if classify
               else F.sum(F.abs(F.col("was").cast("double") - F.col("prediction"))).alias("test_error"))
    tested = joined.groupBy("node").agg(F.count("*").alias("test_rows"), measure)
    judged = "test_hits" if classify else "test_error"
    return tree.leaves.join(tested, "node", "left").select(
        "node", "rows", "prediction", F.coalesce("test_rows", F.lit(0)).alias("test_rows"), F.coalesce(judged, F.lit(0)).alias(judged))
