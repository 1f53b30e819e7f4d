import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescope.functions.numeric import adjusted_kurtosis, adjusted_skew, rounded, rounded_value
from tablescope.functions.text import age_days, format_bytes, format_number, slug_title
from tablescope.operators import correlations as C
from tablescope.operators import profile as P
from tablescope.operators.histograms import Bins, histogram_counts, top_values
from tablescope.operators.quantiles import exact_quantiles
from tablescope.operators.ranks import spaced_positions, value_ranks
from tablescope.operators.value_counts import distinct_counts, modes, most_common

NAN, INF = float("nan"), float("inf")


def test_drop_empty_and_errors(make):
    df = make([(1, None, None), (None, None, None), (2, None, "x")], "a int, b double, c string")
    out = P.drop_empty(df)
    assert out.columns == ["a", "c"] and out.count() == 2
    with pytest.raises(P.EmptyTableError):
        P.drop_empty(make([(None,)], "a int"))
    with pytest.raises(P.EmptyTableError):
        P.profile(make([], "a int"), "t")


def test_nan_counts_as_missing_and_zero_signs_agree(make):
    df = make([(NAN,), (None,), (0.0,), (-0.0,), (1.0,)], "x double")
    row = P.column_profile(df).first()
    assert (row["null_count"], row["unique_count"]) == (2, 2)


def test_profile_figures(make):
    df = make([(1, "a", None), (1, "a", None), (2, None, 5.0), (3, "b", 6.0)], "k int, s string, v double")
    p = P.profile(df, "t")
    m = p.metrics.first()
    assert (m["rows"], m["columns"], m["missing_pct"], m["duplicate_pct"]) == (4, 3, 25.0, 25.0)


def test_nulls_in_different_columns_are_not_duplicates(make):
    df = make([(None, "a"), ("a", None), (None, None), (None, None)], "x string, y string")
    assert P.duplicate_pct(df).first()[0] == 25.0


def test_all_null_rows_leave_the_counts(make):
    m = P.profile(make([(1, None), (None, None), (None, "x")], "a int, b string"), "t").metrics.first()
    assert (m["rows"], m["missing_pct"]) == (2, 50.0)


@pytest.mark.parametrize("values, expected", [
    (["2024-01-02", "2023-12-31T10:00:00"], "date"), (["2024"], "date"), (["01/31/2024", "2024-01-02"], "date"),
    (["5"], "string"), (["2024-01-02", "soon"], "string"), ([None, None], "string"), (["word"], "string")])
def test_date_sniffing(make, values, expected):
    df = make([(v,) for v in values], "x string")
    assert P.column_types(df).first()["type"] == expected


def test_logical_types(spark):
    df = spark.sql("select true b, 1 i, 1.5 d, date'2024-01-01' t, array(1) a, 'x' s")
    assert [r["type"] for r in P.column_types(df).collect()] == ["boolean", "number", "number", "date", "object", "string"]


def test_odd_column_names(make):
    df = make([(1, "x", 2.0), (2, "y", 3.0)], "`a.b` int, `sp ace` string, `ü` double")
    assert [r["name"] for r in P.profile(df, "t").columns.collect()] == ["a.b", "sp ace", "ü"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_subnormal=False)), min_size=6, max_size=60))
def test_histogram_matches_numpy(make, values):
    known = [v for v in values if v is not None]
    if not known:
        return
    df = make([(v,) for v in values], "x double")
    rows = histogram_counts(df, [Bins("x", min(known), max(known), 7)]).orderBy("bin").collect()
    counts, edges = np.histogram(known, bins=7)
    assert [r["count"] for r in rows] == counts.tolist()
    assert np.allclose([r["lo"] for r in rows], edges[:-1])


def test_zero_width_histogram(make):
    rows = histogram_counts(make([(3.0,)] * 4, "x double"), [Bins("x", 3.0, 3.0, 6)]).orderBy("bin").collect()
    assert (rows[0]["lo"], rows[-1]["hi"], [r["count"] for r in rows]) == (2.5, 3.5, [0, 0, 0, 4, 0, 0])


def test_infinite_column_has_no_histogram(make):
    df = make([(float(i), INF if i == 3 else float(i)) for i in range(8)], "a double, b double")
    assert {r["column"] for r in P.numeric_distributions(df).collect()} == {"a"}


@pytest.mark.parametrize("limit", [1, 10, 10_000])
def test_exact_quantiles_in_small_brackets(make, limit):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"a": rng.normal(size=400), "b": rng.integers(0, 4, 400).astype(float), "c": np.where(rng.random(400) < 0.4, 7.0, rng.random(400)),
                         "d": [1.0] * 400})
    df = make([tuple(r) for r in data.to_numpy().tolist()], "a double, b double, c double, d double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = exact_quantiles(df, {c: probs for c in data}, max_bracket_rows=limit)
    for c in data:
        assert np.allclose([got[c][p] for p in probs], data[c].quantile(probs).to_numpy())


def test_quantiles_of_nothing_and_of_one_value(make):
    df = make([(None, 3.0), (None, None)], "x double, y double")
    assert exact_quantiles(df, {"x": [0.5], "y": [0.25]}) == {"x": {0.5: None}, "y": {0.25: 3.0}}


def test_moments_match_pandas(make):
    values = [1.0, 2.0, 2.0, 9.0, 30.0, None]
    row = make([(v,) for v in values], "x double").agg(adjusted_skew(F.col("x")), adjusted_kurtosis(F.col("x"))).first()
    assert np.allclose(row, [pd.Series(values).skew(), pd.Series(values).kurt()])
    flat = make([(2.0,)] * 5, "x double").agg(adjusted_skew(F.col("x")), adjusted_kurtosis(F.col("x"))).first()
    assert tuple(flat) == (0.0, 0.0)


@pytest.mark.parametrize("matrix", [False, True])
def test_correlations_match_pandas(make, monkeypatch, matrix):
    if matrix:
        monkeypatch.setattr(C, "MAX_JVM_COLUMNS", 0)
    rng = np.random.default_rng(2)
    data = pd.DataFrame(rng.normal(size=(80, 4)) * [1, 100, 1, 1] + [0, 1e6, 0, 0], columns=list("abcd"))
    data["b"] += data["a"] * 50
    data["e"] = 0.1
    data.loc[data.index % 3 == 0, "c"] = np.nan
    df = make([tuple(None if v != v else v for v in r) for r in data.to_numpy().tolist()], "a double, b double, c double, d double, e double")
    want = data.corr()
    for r in C.pair_correlations(df).collect():
        expected = want.loc[r["column1"], r["column2"]]
        assert (r["value"] is None) if math.isnan(expected) else abs(r["value"] - expected) < 1e-9


def test_min_pairs(make):
    df = make([(float(i), float(i * i) if i < 9 else None) for i in range(20)], "a double, b double")
    assert C.correlations(df).count() == 0 and C.correlations(df, min_pairs=9).count() == 1


def test_modes_and_ties(make):
    df = make([(10, "b"), (9, "a"), (9, "b"), (10, "a"), (None, None)], "n int, s string")
    assert modes(df, ["n", "s"]) == {"n": 9, "s": "a"}
    assert {r["column"]: (r["mode"], r["mode_count"]) for r in most_common(df).collect()} == {"n": ("9", 2), "s": ("a", 2)}


def test_long_texts_are_counted_once_each(make):
    df = make([("x" * 500,), ("x" * 500,), ("x" * 499 + "y",), ("short",)], "s string")
    assert distinct_counts(df).first()["unique_count"] == 3


def test_texts_by_digest_give_the_same_profile(make):
    df = make([("x" * 500, "2024-01-02", "a"), ("x" * 500, "2024-01-03", ""), ("x" * 64, None, "A"), (None, "2024-01-02", "a")], "s string, d string, t string")
    rows = lambda **kw: P.column_profile(df, **kw).orderBy("position").collect()
    assert rows(digest=True) == rows() and [(r["type"], r["unique_count"]) for r in rows()] == [("string", 2), ("date", 2), ("string", 3)]
    from tablescope.plans.recommend import text_facts
    assert text_facts(df, digest=True) == text_facts(df)


def test_top_values_other(make):
    df = make([(str(i % 13),) for i in range(100)] + [(None,)], "s string")
    rows = top_values(df, ["s"], 10).orderBy("bin").collect()
    assert len(rows) == 11 and rows[-1]["value"] == "Other" and sum(r["count"] for r in rows) == 100


def test_variance_rank_above_limit(make):
    df = make([tuple(float(i * (c + 1) % 17) * (c + 1) for c in range(9)) for i in range(40)], ", ".join(f"c{i} double" for i in range(9)))
    kept = P.variance_rank(df)
    want = df.toPandas().var().sort_values(ascending=False).index[:8].tolist()
    assert kept == want


@pytest.mark.parametrize("n, points", [(7, 3), (501, 200), (1000, 300)])
def test_spaced_positions(make, n, points):
    values = [float(i // 5) for i in range(n)]
    df = make([(v,) for v in reversed(values)], "x double")
    got = spaced_positions(value_ranks(df, F.col("x")), n, points).orderBy("i").collect()
    at = np.linspace(0, n - 1, points, dtype=int)
    assert [r["i"] for r in got] == list(range(points))
    assert [r["value"] for r in got] == [values[i] for i in at]


def test_ranks_do_not_depend_on_partitions(make):
    df = make([(i * 37 % 101,) for i in range(300)], "x int")
    a = value_ranks(df.repartition(1), F.col("x")).orderBy("value").collect()
    b = value_ranks(df.repartition(7), F.col("x")).orderBy("value").collect()
    assert a == b and [r["index"] for r in a] == list(range(len(a)))


def test_display_forms(make):
    df = make([(2_500_000.0,), (-1200.0,), (3.25,), (0.05,), (0.0004,)], "x double")
    assert [r[0] for r in df.select(format_number(F.col("x"))).collect()] == ["2.5M", "-1.2K", "3.3", "0.05", "0.000"]
    sizes = make([(10,), (2048,), (5 * 1024 ** 2,), (3 * 1024 ** 3,)], "b bigint")
    assert [r[0] for r in sizes.select(format_bytes(F.col("b"))).collect()] == ["10 B", "2.0 KB", "5.0 MB", "3.0 GB"]
    assert make([("me/my-nice_set",)], "s string").select(slug_title(F.col("s"))).first()[0] == "My Nice Set"


@pytest.mark.parametrize("text, days", [("2024-06-29T00:00:00Z", 1), ("2024-06-29T02:00:00+02:00", 1), ("2024-06-29T00:00:00", None), ("", None), ("junk", None),
                                        ("2024-06-29T00:00:01Z", 0), ("2024-07-01T00:00:00Z", -1)])
def test_age_days(make, text, days):
    assert make([(text,)], "s string").select(age_days(F.col("s"), F.lit("2024-06-30 00:00:00"))).first()[0] == days


@pytest.mark.parametrize("x, want", [(1.005, 1.01), (2.675, 2.68), (NAN, None), (INF, None), (1e30, 1e30)])
def test_rounding(make, x, want):
    assert make([(x,)], "x double").select(rounded(F.col("x"), 2)).first()[0] == want
    if x == x and abs(x) < 1e20:
        assert rounded_value(x, 2) == want


def test_preview_is_json_safe(make):
    row = P.preview(make([(2, NAN), (1, 1.23456)], "k int, v double"), 20, "k").collect()
    assert [(r["k"], r["v"]) for r in row] == [(1, 1.2346), (2, None)]


def test_row_cap_warns(make):
    df = make([(i,) for i in range(10)], "k int")
    capped, warnings = P.row_cap(df, 4, "k")
    assert capped.count() == 4 and warnings
    assert P.row_cap(df, 10, "k")[1] == []


def test_wide_table(spark):
    wide = spark.range(60).select(*[(F.col("id") * (i + 1) % 17).cast("double").alias(f"c{i}") for i in range(70)])
    got = exact_quantiles(wide, {c: [0.25, 0.5, 0.75] for c in wide.columns})
    want = wide.toPandas().quantile([0.25, 0.5, 0.75])
    assert all(np.allclose([got[c][p] for p in (0.25, 0.5, 0.75)], want[c]) for c in wide.columns)
    p = P.profile(wide, "w")
    assert (p.columns.count(), p.correlations.count(), p.distributions.count()) == (70, 20, 48)


def test_many_tables_at_once(make):
    tables = {f"t{i}": make([(j,) for j in range(i + 1)], "k int") for i in range(6)}
    rows = {r["dataset_id"]: r["rows"] for r in P.profile_many(tables).metrics.collect()}
    assert rows == {f"t{i}": i + 1 for i in range(6)}
