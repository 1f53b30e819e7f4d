import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescope.operators import augment as A
from tablescope.operators import cleaning as C
from tablescope.operators import encode as E
from tablescope.operators import missing as M
from tablescope.operators.chained import bayesian_ridge, impute_chained
from tablescope.operators.power import best_exponents, handle_skewness
from tablescope.operators.split import assign_split, baseline, train_test_split
from tablescope.plans.prep import apply_steps, run_steps


def _frame(make, data):
    ddl = ", ".join(f"{c} double" for c in data)
    return make([tuple(None if v != v else float(v) for v in r) for r in data.to_numpy().tolist()], ddl)


def _sorted(df, key):
    return df.toPandas().sort_values(key).reset_index(drop=True)


def brute_knn(data, k=5):
    """Every pair, NaN-Euclidean, ties to the smaller value."""
    x = data.to_numpy(dtype=float)
    out, p = x.copy(), x.shape[1]
    for i, c in zip(*np.nonzero(np.isnan(x))):
        found = []
        for j in range(len(x)):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if not np.isnan(x[j, c]) and both.any():
                found.append((sum((x[i, f] - x[j, f]) ** 2 for f in range(p) if both[f]) * (p / both.sum()), x[j, c]))
        out[i, c] = np.mean([v for _, v in sorted(found)[:k]]) if found else np.nanmean(x[:, c])
    return out


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 6, "block_donors": 5, "block_queries": 3}, {"cell_rows": 2, "block_donors": 1000, "block_queries": 1000}])
def test_knn_equals_brute_force(make, sizes):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"k": np.arange(90.0), "a": rng.normal(size=90) * 30, "b": rng.integers(0, 5, 90) * 10.0, "c": rng.normal(size=90)})
    data = data.mask(rng.random(data.shape) < 0.2)
    data["k"] = np.arange(90.0)
    data.loc[88, ["a", "b", "c"]] = np.nan
    got = _sorted(M.impute_knn(_frame(make, data), **sizes), "k")
    assert np.allclose(got.to_numpy(), brute_knn(data))


def test_knn_with_copies_and_a_hot_value(make):
    """A third of the rows share one vector; weights must stand for copies."""
    data = pd.DataFrame({"a": [1.0] * 30 + list(np.arange(60.0)), "b": [5.0] * 30 + list(np.arange(60.0) * 2)})
    data.loc[[3, 40, 70], "b"] = np.nan
    data["id"] = 0.0
    got = M.impute_knn(_frame(make, data), cell_rows=5, block_donors=3, block_queries=2).toPandas()
    want = pd.DataFrame(brute_knn(data), columns=data.columns)
    key = ["a", "b"]
    assert np.allclose(got.sort_values(key)[key].to_numpy(), want.sort_values(key)[key].to_numpy())


def test_knn_without_comparable_rows_uses_the_mean(make):
    data = pd.DataFrame({"a": [1.0, np.nan, np.nan, 5.0], "b": [np.nan, 2.0, 4.0, np.nan]})
    got = M.impute_knn(_frame(make, data)).toPandas()
    assert sorted(got["a"]) == [1.0, 3.0, 3.0, 5.0] and sorted(got["b"]) == [2.0, 3.0, 3.0, 4.0]


def test_chained_follows_the_full_matrix(make):
    """The sufficient-statistics rounds equal the same rounds on the whole matrix."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 3))
    data = pd.DataFrame({"a": base[:, 0], "b": base[:, 0] * 2 + 0.1 * base[:, 1], "c": base[:, 2] + base[:, 0]})
    data = data.mask(rng.random(data.shape) < [0.05, 0.15, 0.25])
    data["k"] = np.arange(200.0)
    got = _sorted(impute_chained(_frame(make, data).repartition(3)), "k").to_numpy()

    raw = data.to_numpy(dtype=float)
    gap = np.isnan(raw)
    x = np.where(gap, np.nanmean(raw, axis=0), raw)
    order = sorted((c for c in range(4) if gap[:, c].any()), key=lambda c: (gap[:, c].sum(), c))
    for _ in range(10):
        before = x.copy()
        for c in order:
            rest = [i for i in range(4) if i != c]
            rows = ~gap[:, c]
            z, y = x[rows][:, rest], x[rows, c]
            zc, yc = z - z.mean(0), y - y.mean()
            w, b = bayesian_ridge(len(y), z.mean(0), y.mean(), zc.T @ zc, zc.T @ yc, yc @ yc)
            x[gap[:, c], c] = x[gap[:, c]][:, rest] @ w + b
        if np.abs(x - before).sum(axis=1).max() < 1e-3 * np.abs(raw[~gap]).max():
            break
    assert np.allclose(got, x, atol=1e-6)


def test_chained_recovers_a_line(make):
    data = pd.DataFrame({"a": np.arange(50.0), "b": np.arange(50.0) * 3 + 1})
    data.loc[[5, 20], "b"] = np.nan
    got = _sorted(impute_chained(_frame(make, data)), "a")
    assert np.allclose(got["b"], np.arange(50.0) * 3 + 1, atol=0.05)


def test_fills(make):
    df = make([(1, "a", 1.0), (None, "a", 2.0), (3, None, None), (4, "b", 10.0)], "i int, s string, d double")
    assert sorted(r["d"] for r in M.fill_mean(df).collect()) == pytest.approx([1.0, 2.0, 13 / 3, 10.0])
    assert sorted(r["i"] for r in M.fill_median(df).collect()) == [1.0, 3.0, 3.0, 4.0]
    assert M.fill_mode(df).schema["i"].dataType == df.schema["i"].dataType
    assert {r["s"] for r in M.fill_mode(df).collect()} == {"a", "b"}
    empty = make([(None, 1), (None, 2)], "s string, k int")
    assert {r["s"] for r in M.fill_mean(empty).collect()} == {"Unknown"}


def test_smart_tiers(make):
    rows = [(float(i), None if i < 60 else 1.0, None if i % 10 == 0 else float(i % 7), None if i == 5 else float(i), None if i == 7 else "x") for i in range(100)]
    out = M.handle_missing(make(rows, "k double, mostly double, some double, few double, t string"))
    assert out.columns == ["k", "some", "few", "t"] and out.na.drop("any").count() == 100


def test_unknown_strategy_is_smart(make):
    assert M.handle_missing(make([(1.0,), (None,)], "x double"), "nonsense").count() == 2


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e5, 1e5, allow_subnormal=False), min_size=3, max_size=40))
def test_scalers_invert(make, values):
    s = pd.Series(values)
    df = make([(float(i), v) for i, v in enumerate(values)], "k double, x double")
    span = (s.max() - s.min()) or 1.0
    got = _sorted(C.scale_minmax(df, ["x"]), "k")["x"]
    assert np.allclose(got * span + s.min(), s, atol=1e-6)
    iqr = (s.quantile(0.75) - s.quantile(0.25)) or 1.0
    got = _sorted(C.scale_robust(df, ["x"]), "k")["x"]
    assert np.allclose(got * iqr + s.median(), s, atol=1e-6)


def test_constant_columns_scale_to_zero(make):
    df = make([(0.1, None)] * 3, "x double, empty double")
    for method in ("minmax", "zscore", "robust"):
        assert {tuple(r) for r in C.normalize(df, method).collect()} == {(0.0, None)}
    assert C.normalize(df, "other") is df


def test_outlier_rules(make):
    rows = [(float(i), 5.0) for i in range(20)] + [(1000.0, 5.0), (None, 5.0)]
    df = make(rows, "x double, same double")
    assert C.outliers_iqr(df).count() == 21
    assert C.outliers_zscore(df.select("x"), threshold=3).count() == 21
    assert C.outliers_zscore(df).count() == 0          # the constant column takes every row
    assert C.remove_outliers(df, "other").count() == 22


def test_sequential_filters_see_the_rows_left(make):
    rng = np.random.default_rng(5)
    data = pd.DataFrame(rng.standard_t(2, size=(200, 3)), columns=list("abc"))
    want = data
    for c in data:
        q1, q3 = want[c].quantile(0.25), want[c].quantile(0.75)
        want = want[(want[c] >= q1 - 1.5 * (q3 - q1)) & (want[c] <= q3 + 1.5 * (q3 - q1))]
    assert C.outliers_iqr(_frame(make, data)).count() == len(want)


def test_remove_correlated_drops_the_left_column(make):
    df = make([(float(i), float(2 * i), float(i % 3)) for i in range(30)], "a double, b double, c double")
    assert C.remove_correlated(df).columns == ["b", "c"]


def test_drop_low_variance(make):
    df = make([(1.0, float(i), "x", None, 0.0 if i else None) for i in range(5)], "one double, v double, s string, e double, z double")
    assert C.drop_low_variance(df).columns == ["v"]


def test_duplicates_with_nulls(make):
    assert C.remove_duplicates(make([(None, 1.0), (None, 1.0), (2, None)], "a int, b double")).count() == 2


def test_onehot_matches_get_dummies(make):
    data = pd.DataFrame({"k": [1, 2, 3, 4], "c": ["b", "a", None, "c c"], "d": ["x", "x", "x", "x"]})
    df = make([(1, "b", "x"), (2, "a", "x"), (3, None, "x"), (4, "c c", "x")], "k int, c string, d string")
    want = pd.get_dummies(data, columns=["c", "d"], drop_first=True, dtype=int)
    got = _sorted(E.encode_onehot(df), "k")
    assert got.columns.tolist() == want.columns.tolist() and (got.to_numpy() == want.to_numpy()).all()


@pytest.mark.parametrize("n, expected", [(20, 19), (21, 0)])
def test_onehot_limit(make, n, expected):
    out = E.encode_onehot(make([(f"v{i:02d}",) for i in range(n)], "c string"))
    assert len([c for c in out.columns if c.startswith("c_")]) == expected


@pytest.mark.parametrize("small", [100_000, 1])
def test_label_codes_follow_sorted_values(make, monkeypatch, small):
    monkeypatch.setattr(E, "SMALL_DICTIONARY", small)
    monkeypatch.setattr(E, "HOT_SHARE", 4)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"é{i % 11}") for i in range(60)]
    got = _sorted(E.encode_label(make(rows, "k int, c string")), "k")["c"].tolist()
    names = sorted({v or "nan" for _, v in rows})
    assert got == [names.index(v or "nan") for _, v in rows]


def test_yeojohnson_standardises_and_is_the_best(make):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.exponential(size=300) * 10, [-1.0, -0.5]])
    df = make([(float(v),) for v in x], "x double")
    lam = best_exponents(df, ["x"], "yeo_johnson")["x"]

    def score(p):
        t = np.where(x >= 0, ((1 + np.abs(x)) ** p - 1) / p, -(((1 + np.abs(x)) ** (2 - p)) - 1) / (2 - p))
        return (p - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x))) - len(x) / 2 * np.log(t.var())

    assert all(score(lam) >= score(lam + d) for d in (-0.01, -0.001, 0.001, 0.01))
    row = handle_skewness(df).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    assert abs(row["m"]) < 1e-9 and abs(row["s"] - 1) < 1e-9


def test_exponent_outside_the_first_grid(make):
    x = np.exp(-np.linspace(0, 4, 200) ** 0.5) + 10
    lam = best_exponents(make([(float(v),) for v in x], "x double"), ["x"], "box_cox")["x"]
    assert abs(lam) > 5


def test_skew_gates(make):
    df = make([(float(i ** 4), float(-i ** 4), float(i)) for i in range(1, 20)], "up double, down double, even double")
    out = _sorted(handle_skewness(df, "log"), "even")
    assert np.allclose(out["up"], np.log1p(np.arange(1, 20.0) ** 4)) and out["down"].min() == -(19.0 ** 4)
    assert handle_skewness(df, "none of these").columns == df.columns


def test_smote_points_lie_between_neighbours(make):
    rng = np.random.default_rng(7)
    rows = [(i, float(a), float(b), "big") for i, (a, b) in enumerate(rng.normal(size=(40, 2)))]
    rows += [(100 + i, float(a), float(b), "small") for i, (a, b) in enumerate(rng.normal(size=(7, 2)) + 5)]
    df = make(rows, "id int, a double, b double, y string").drop("id")
    out = A.smote(df, "y", cell_rows=3, block_donors=2, block_queries=2)
    assert {r["value"]: r["count"] for r in A.class_distribution(out, "y").collect()} == {"big": 40, "small": 40}
    base = np.array([r[1:3] for r in rows if r[3] == "small"])
    known = {tuple(v) for v in base}
    new = [(r["a"], r["b"]) for r in out.where("y = 'small'").collect() if (r["a"], r["b"]) not in known]
    assert len(new) == 33
    for point in np.array(new):
        on_edge = False
        for i in range(len(base)):
            near = np.argsort(((base - base[i]) ** 2).sum(axis=1), kind="stable")[1:6]
            for j in near:
                d = base[j] - base[i]
                u = (point - base[i]) @ d / (d @ d)
                on_edge |= -1e-9 <= u <= 1 + 1e-9 and np.allclose(base[i] + u * d, point, atol=1e-9)
        assert on_edge


def test_smote_refusals_and_repeatability(make):
    df = make([(float(i), float(i * i), "a" if i < 12 else "b") for i in range(16)], "x double, z double, y string")
    assert sorted(A.smote(df, "y").collect()) == sorted(A.smote(df, "y").collect())
    for bad, why in ((df.select("x", "y"), "two numeric"), (df.where("y = 'a'"), "two classes")):
        _, report = A.augment(bad, "y")
        assert not report.success and why in report.summary
    lone = df.where("y = 'a' or x = 15")
    assert not A.augment(lone, "y")[1].success
    assert not A.augment(df, "nope")[1].success and not A.augment(df, "y", method="odd")[1].success


@pytest.mark.parametrize("n, more", [(10, 40), (100, 400), (300, 700), (2000, 2000)])
def test_rows_to_add(n, more):
    assert A.rows_to_add(n) == more


def test_bootstrap(make):
    df = make([(i, float(i), "t") for i in range(50)], "k int, x double, s string")
    out = A.bootstrap_noise(df)
    assert out.count() == 250 and sorted(out.collect()) == sorted(A.bootstrap_noise(df).collect())
    noise = [abs(r["x"] - round(r["x"])) for r in out.collect() if r["x"] != round(r["x"])]
    assert len(noise) == 200


def test_places_are_dense_per_group(make, monkeypatch):
    monkeypatch.setattr(A, "BUCKET", 7)
    df = make([("a" if i % 3 else "b", i, i % 4 + 1) for i in range(90)], "grp string, v int, cnt bigint")
    rows = A._places(df, ["v"], 1).collect()
    assert sorted(rows) == sorted(A._places(df.repartition(5), ["v"], 1).collect())
    for g in "ab":
        at = 0
        for start, cnt in sorted((r["start"], r["cnt"]) for r in rows if r["grp"] == g):
            assert start == at
            at += cnt


@pytest.mark.parametrize("bucket", [20_000, 10])
def test_bootstrap_and_smote_do_not_depend_on_partitions(make, monkeypatch, bucket):
    """One, four and sixteen partitions in another order: the same rows; with small buckets draws go down two levels of splits."""
    monkeypatch.setattr(A, "BUCKET", bucket)
    monkeypatch.setattr(A, "FAN", 4)
    rng = np.random.default_rng(9)
    rows = [(float(a), float(b), "xy"[int(i % 9 == 0)], [1, i]) for i, (a, b) in enumerate(np.round(rng.normal(size=(300, 2)), 2))] + [(1.0, 2.0, "x", [0, 0])] * 100
    df = make(rows, "a double, b double, y string, l array<int>")
    for run in (lambda t: A.bootstrap_noise(t), lambda t: A.smote(t.drop("l"), "y")):
        first = sorted(map(str, run(df.repartition(1)).collect()))
        assert len(first) in (1000, 2 * sum(r[2] == "x" for r in rows))
        assert all(sorted(map(str, run(df.repartition(n, "a")).collect())) == first for n in (4, 16))


def test_bootstrap_draws_every_row_alike(make):
    """200 rows, one of them 100 times: it gets about half of the 800 draws."""
    df = make([(0.0, "hot")] * 100 + [(float(i), "s") for i in range(1, 101)], "x double, s string")
    out = A.bootstrap_noise(df)
    drawn = {r["s"]: r["count"] for r in out.groupBy("s").count().collect()}
    assert out.count() == 1000 and 300 < drawn["hot"] - 100 < 500


def test_split(make):
    df = make([(i, "a" if i < 100 else "b") for i in range(1000)], "k int, y string")
    train, test = train_test_split(df, "k")
    assert train.count() + test.count() == 1000 and 130 < test.count() < 270
    assert assign_split(df, "k").exceptAll(assign_split(df.repartition(5), "k")).count() == 0
    counts = {(r["y"], r["split"]): r["count"] for r in assign_split(df, "k", stratify="y").groupBy("y", "split").count().collect()}
    assert counts[("a", "test")] == 20 and counts[("b", "test")] == 180
    both = assign_split(df, "k", stratify="y")
    assert both.exceptAll(assign_split(df.repartition(7), "k", stratify="y")).count() == 0
    assert "Exchange hashpartitioning" not in both._jdf.queryExecution().executedPlan().toString()      # no row is shuffled


def test_stratified_split_of_odd_classes(make):
    """Null and single-row classes, a key that fills a class, shares at both ends."""
    df = make([(i, None if i < 10 else "one" if i == 10 else "same" if i < 50 else "big") for i in range(5000)], "k int, y string").withColumn(
        "k", F.when(F.col("y") == "same", 7).otherwise(F.col("k")))
    for share in (0.0, 0.2, 0.5, 1.0):
        got = {r["y"]: (r["n"], r["t"]) for r in assign_split(df, "k", share, stratify="y").groupBy("y").agg(
            F.count("*").alias("n"), F.count(F.when(F.col("split") == "test", 1)).alias("t")).collect()}
        for y in (None, "big", "one"):
            assert got[y][1] == int(got[y][0] * share + 0.5)
        assert got["same"] == (39, 39 if share >= 0.5 else 0)


@pytest.mark.parametrize("task, metric", [("classification", "accuracy"), ("regression", "r2")])
def test_baseline(make, task, metric):
    df = make([(i, float(i % 10), "u" if i % 2 else "v", i % 2) for i in range(200)], "k int, x double, s string, y int")
    row = baseline(df, "y", task, key="k", trees=5).first()
    assert row["metric"] == metric and row["score"] > 0.8


def test_steps_skip_failures_and_unknown_actions(make):
    df = make([(1.0, "a"), (1.0, "a"), (None, "b"), (4.0, None)], "x double, s string")
    steps = [{"action": "remove_duplicates"}, {"action": "what"}, {"action": "normalize", "params": {"method": "minmax", "columns": 5}},
             {"action": "handle_missing", "params": {"strategy": "drop_rows"}}]
    out, applied, notes = apply_steps(df, steps)
    assert applied == ["remove_duplicates", "handle_missing"] and "normalize: failed (TypeError)" in notes and out.count() == 1
    result = run_steps(df, steps, "t")
    row = result.report.first()
    assert (row["rows_removed"], row["columns_removed"], row["columns_added"]) == (3, 0, 0)
    assert run_steps(df, []).report.first()["summary"] == "No changes applied."


def test_steps_do_not_depend_on_partitions(make):
    df = make([(float(i), float(i % 9) if i % 4 else None, "abc"[i % 3]) for i in range(120)], "k double, x double, s string")
    steps = [{"action": "handle_missing"}, {"action": "encode_categorical"}, {"action": "normalize"}]
    a, b = (_sorted(apply_steps(df.repartition(n), steps)[0], "k") for n in (1, 6))
    assert np.allclose(a.to_numpy(dtype=float), b.to_numpy(dtype=float))
