"""Correlation sums and distinct counts of many columns at once."""

import math
from itertools import combinations

import numpy as np
import pandas as pd

from tablescope.operators import correlations as C
from tablescope.operators.value_counts import distinct_counts


def _rows(data: pd.DataFrame) -> list[tuple]:
    return [tuple(None if v != v else float(v) for v in r) for r in data.to_numpy().tolist()]


def _plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.debug.maxToStringFields")


def test_correlation_sums_are_shared_by_pattern_of_gaps(make):
    """Twelve columns, six with gaps: one sum for each column and pair, few enough for generated code."""
    rng = np.random.default_rng(4)
    data = pd.DataFrame(rng.normal(size=(300, 12)), columns=[f"c{i}" for i in range(12)])
    data["c1"] += data["c0"] * 3
    for k in range(6):
        data.loc[rng.random(300) < 0.3, f"c{2 * k}"] = np.nan
    data.loc[data["c0"].notna(), "c2"] = np.nan                 # c0 and c2 share no row
    df = make(_rows(data), ", ".join(f"c{i} double" for i in range(12)))
    pairs = C.pair_correlations(df)
    assert _plan(pairs).count("partial_sum(") <= 100
    got, want, seen = {(r["column1"], r["column2"]): r for r in pairs.collect()}, data.corr(), data.notna().astype(int)
    assert set(got) == set(combinations(data.columns, 2))
    for (a, b), r in got.items():
        assert r["pairs"] == (seen[a] * seen[b]).sum()
        assert (r["value"] is None) if math.isnan(want.loc[a, b]) else abs(r["value"] - want.loc[a, b]) < 1e-9
    assert got["c0", "c2"]["pairs"] == 0


def test_correlations_of_an_empty_table_list_every_pair(make):
    got = C.pair_correlations(make([], "a double, b int, c double")).orderBy("pos1", "pos2").collect()
    assert [(r["column1"], r["column2"], r["pairs"], r["value"]) for r in got] == [("a", "b", 0, None), ("a", "c", 0, None), ("b", "c", 0, None)]


def test_distinct_integers_are_counted_in_words(spark, make):
    ends = [-2**63, -2**63 + 1, 2**63 - 1, 2**63 - 64, -1, 0, 1, 63, 64, -64, -65, 0, -1, None]
    df = make([(v, (v or 0) % 7, float(v or 0), None) for v in ends], "k bigint, i int, d double, nothing smallint")
    counts = {r["column"]: r["unique_count"] for r in distinct_counts(df).collect()}
    assert counts == {"k": 11, "i": len({(v or 0) % 7 for v in ends}), "d": len({float(v or 0) for v in ends})}
    plan = _plan(distinct_counts(spark.range(100_000)))
    assert "partial_bit_or" in plan         # 64 neighbouring keys are one row of the shuffle
