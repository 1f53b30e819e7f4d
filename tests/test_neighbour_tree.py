"""The k-d tree behind neighbour imputation and SMOTE."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.operators import neighbours as N


def table(spark, x, grp=None):
    rows = [([None if v != v else float(v) for v in row], "" if grp is None else grp[i], 1) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "x array<double>, grp string, cnt bigint").groupBy("x", "grp").agg(F.sum("cnt").alias("cnt"))


def asked(spark, x, target=-1):
    return spark.createDataFrame([([None if v != v else float(v) for v in row], target, "") for row in x], "q array<double>, target int, grp string")


def brute(q, x, k):
    return np.sort(((x - q) ** 2).sum(1))[:k]


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r["q"]), []).extend([r["dist"]] * r["weight"])
    return {q: np.sort(d) for q, d in out.items()}


@pytest.mark.parametrize("most", [40, 1])
def test_deep_trees_equal_brute_force(spark, monkeypatch, most):
    """With few upper boxes in a task, the cells below them are searched in co-grouped blocks."""
    monkeypatch.setattr(N, "MAX_CELLS", most)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(1500, 3)), rng.normal(size=(1500, 3)) * 0.01 + 4, np.ones((30, 3))])
    q = np.concatenate([x[::100] + 0.001, rng.normal(size=(5, 3)) * 9])
    got = found(N.nearest(asked(spark, q), table(spark, x), 3, 4, cell_rows=20, block_queries=7, block_donors=11))
    assert len(got) == len(q)
    for row in q:
        assert np.allclose(got[tuple(row)], brute(row, x, 4))


def test_a_value_that_fills_a_feature(spark):
    """Nine tenths of the rows share a value in two features: every split still makes smaller or narrower parts."""
    rng = np.random.default_rng(6)
    x = np.stack([np.where(rng.random(900) < 0.9, 5.0, rng.normal(size=900)), np.where(rng.random(900) < 0.9, 0.0, rng.normal(size=900)),
                  rng.integers(0, 300, 900).astype(float)], axis=1)
    placed, boxes = N._tree(table(spark, x), 3, 15)
    most, rows = boxes.agg(F.max("vectors"), F.sum("rows")).first()
    assert most <= 15 and rows == 900 and placed.select("cell").distinct().count() == boxes.count()
    q = x[::90]
    got = found(N.nearest(asked(spark, np.unique(q, axis=0)), table(spark, x), 3, 5, cell_rows=15))
    for row in np.unique(q, axis=0):
        assert np.allclose(got[tuple(row)], brute(row, x, 5))


def test_pairs_of_a_query_do_not_grow_with_the_table(spark):
    """20,000 and 160,000 rows: as many cells within the radius of a query."""
    per_query = []
    for n in (20_000, 160_000):
        points = spark.range(n).select(F.array(*[F.rand(7 + i) for i in range(3)]).alias("x"), F.lit("").alias("grp"), F.lit(1).cast("bigint").alias("cnt"))
        donors = N.materialize(points, "test-donors")
        queries = N.materialize(donors.limit(200).select(F.col("x").alias("q"), F.lit(-1).alias("target"), "grp"), "test-queries")
        tree = N.Search(donors, 3, 5, False, 200, 8192, 2048, 4096)
        pairs = tree.reached(tree.radius(queries))
        visited = pairs.join(tree.boxes.select("cell", "vectors"), "cell").agg(F.sum("vectors")).first()[0]
        per_query.append((pairs.count() / 200, visited / 200))
    (small, few), (large, many) = per_query
    assert large < 1.5 * small + 1 and many < 1.5 * few + 200 and many < 160_000 * 0.02
