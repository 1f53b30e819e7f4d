"""Inputs beyond what one task holds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.operators import missing as M
from tablescope.operators import neighbours as N
from tablescope.operators.split import baseline
from tablescope.queries.charts import QUERIES

from test_clean import _frame, _sorted, brute_knn


def test_neighbours_over_25_000_patterns_of_gaps(spark):
    """15 features, 25,000 patterns of nulls: more cells than a task holds."""
    p, k, n = 15, 5, 25_000
    rng = np.random.default_rng(8)
    present = (np.arange(1, n + 1)[:, None] >> np.arange(p)[None, :]) & 1
    x = np.where(present == 1, np.round(rng.normal(size=(n, p)), 3), np.nan)
    as_lists = lambda m: [[None if v != v else float(v) for v in row] for row in m]
    donors = spark.createDataFrame([(v, "", 1) for v in as_lists(x)], "x array<double>, grp string, cnt bigint")
    asked = [(i, int(np.nonzero(present[i] == 0)[0][0])) for i in range(0, n, 1000) if (present[i] == 0).any()]
    queries = spark.createDataFrame([(as_lists(x[i:i + 1])[0], t, "") for i, t in asked], "q array<double>, target int, grp string")
    got = {}
    for r in N.nearest(queries, donors, p, k).collect():
        got.setdefault((tuple(r["q"]), r["target"]), []).extend([r["dist"]] * r["weight"])
    assert len(got) == len(asked) >= 20
    for i, t in asked:
        both = (present & present[i]) == 1
        d = np.where(both, np.where(both, x - x[i], 0.0) ** 2, 0.0).sum(1) * (p / np.maximum(both.sum(1), 1))
        d = np.sort(d[(present[:, t] == 1) & both.any(1)])[:k]
        assert np.allclose(sorted(got[(tuple(as_lists(x[i:i + 1])[0]), t)]), d)


@pytest.mark.parametrize("sizes", [{"block_boxes": 3, "block_queries": 4, "block_donors": 5}, {"block_boxes": 100}])
def test_blocks_of_boxes_equal_brute_force(make, monkeypatch, sizes):
    monkeypatch.setattr(N, "MAX_CELLS", 2)
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"k": np.arange(90.0), "a": rng.normal(size=90) * 30, "b": rng.integers(0, 5, 90) * 10.0, "c": rng.normal(size=90)})
    data = data.mask(rng.random(data.shape) < 0.2)
    data["k"] = np.arange(90.0)
    data.loc[88, ["a", "b", "c"]] = np.nan
    assert np.allclose(_sorted(M.impute_knn(_frame(make, data), **sizes), "k").to_numpy(), brute_knn(data))


def test_many_classes_keep_to_themselves(spark, monkeypatch):
    """Own rows and groups in blocks: the same neighbours as with all boxes in a task."""
    rng = np.random.default_rng(5)
    rows = [([float(a), float(b)], f"g{i % 7}", int(i % 3 + 1)) for i, (a, b) in enumerate(rng.integers(0, 40, (140, 2)).tolist())]
    pool = spark.createDataFrame(rows, "x array<double>, grp string, cnt bigint").groupBy("x", "grp").agg(F.sum("cnt").alias("cnt"))
    asked = pool.select(F.col("x").alias("q"), F.lit(-1).alias("target"), "grp")
    run = lambda **sizes: sorted(map(str, N.nearest(asked, pool, 2, 3, own=True, **sizes).collect()))
    want = run()
    monkeypatch.setattr(N, "MAX_CELLS", 2)
    assert run(block_boxes=1, block_queries=4) == want and run() == want


def test_scatter_query_takes_all_documents(spark, tmp_path):
    """One document more than a million, the last one far off; it must be a point, and count in the ranges."""
    n = 1_000_001
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"),
                          F.col("id").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["chart_scatter"][0](spark, str(tmp_path)).count() == n
    stats = QUERIES["chart_scatter_stats"][0](spark, str(tmp_path)).first()
    assert (stats["points"], stats["x_min"], stats["x_max"], stats["correlation"]) == (n, 0.0, n - 1.0, 1.0)


@pytest.mark.parametrize("values", [100, 101, 400])
def test_baseline_keeps_text_columns_of_many_values(make, values):
    """Only the text tells the class; it must stay in the model however many values it has."""
    df = make([(i, f"v{i % values}", int(i % values < values / 2)) for i in range(values * 8)], "k int, s string, y int")
    row = baseline(df, "y", key="k", trees=20).first()
    assert row["columns"] == ["k", "s"] and row["score"] > 0.7
