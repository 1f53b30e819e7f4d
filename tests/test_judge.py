import pytest
from pyspark.sql import functions as F

from tablescope.operators import charts as C
from tablescope.operators import profile as P
from tablescope.plans import bias as B
from tablescope.plans.analyze import analyze
from tablescope.plans.compare import compare, compare_winner, dataset_summary
from tablescope.plans.insights import insights
from tablescope.plans.recommend import class_models, column_roles, detect_domain, detect_target, recommend, use_cases
from tablescope.plans.score import overall_score, quality_score
from tablescope.session import local_table


@pytest.fixture()
def fake(spark):
    """fake(metrics, columns, correlations, distributions) -> Profile of table 't'."""
    def build(rows=1000, cols=3, missing=0.0, dup=0.0, columns=(), pairs=(), bins=()):
        return P.Profile(
            local_table(spark, [{"dataset_id": "t", "rows": rows, "columns": cols, "missing_pct": missing, "duplicate_pct": dup}], P.METRICS),
            local_table(spark, [{"dataset_id": "t", "position": i, "name": n, "type": t, "null_count": k, "unique_count": u}
                                for i, (n, t, k, u) in enumerate(columns)], P.COLUMNS),
            local_table(spark, [{"dataset_id": "t", "rank": i + 1, "column1": a, "column2": b, "value": v} for i, (a, b, v) in enumerate(pairs)], P.CORRELATIONS),
            local_table(spark, [{"dataset_id": "t", "column": c, "kind": "numeric", "bin": i, "label": str(i), "lo": 0.0, "hi": 1.0, "count": n}
                                for c, counts in bins for i, n in enumerate(counts)], P.DISTRIBUTIONS))
    return build


@pytest.mark.parametrize("missing, points, label", [(0, 30, "Excellent"), (1, 30, "Excellent"), (1.01, 25, "Good"), (5, 25, "Good"), (15, 18, "Fair"), (15.1, 10, "Poor"),
                                                    (30, 10, "Poor"), (31, 3, "Poor")])
def test_completeness_ladder(fake, missing, points, label):
    row = quality_score(fake(missing=float(missing))).where("name = 'completeness'").first()
    assert (row["score"], row["label"]) == (points, label)


@pytest.mark.parametrize("dup, points, label", [(0.5, 20, "Excellent"), (2, 16, "Good"), (5, 10, "Fair"), (15, 5, "Poor"), (16, 1, "Poor")])
def test_uniqueness_ladder(fake, dup, points, label):
    row = quality_score(fake(dup=float(dup))).where("name = 'uniqueness'").first()
    assert (row["score"], row["label"]) == (points, label)


@pytest.mark.parametrize("rows, cols, points, label", [(10_000, 3, 25, "Excellent"), (1000, 2, 20, "Good"), (1000, 1, 15, "Good"), (500, 2, 20, "Fair"), (100, 1, 15, "Fair"),
                                                       (50, 9, 10, "Poor"), (49, 9, 5, "Poor")])
def test_size_ladder(fake, rows, cols, points, label):
    row = quality_score(fake(rows=rows, cols=cols)).where("name = 'size'").first()
    assert (row["score"], row["label"]) == (points, label)


@pytest.mark.parametrize("types, points, label", [([], 12, "Unknown"), (["number", "string", "date"], 25, "Excellent"), (["number", "boolean", "date"], 20, "Good"),
                                                  (["number"], 15, "Fair"), (["date"], 10, "Poor")])
def test_diversity_ladder(fake, types, points, label):
    row = quality_score(fake(columns=[(f"c{i}", t, 0, 9) for i, t in enumerate(types)])).where("name = 'diversity'").first()
    assert (row["score"], row["label"]) == (points, label)


def test_overall(fake):
    row = overall_score(fake(rows=10, missing=40.0, dup=20.0, columns=[("d", "date", 0, 5)])).first()
    assert (row["score"], row["quality"]) == (3 + 1 + 5 + 10, "low")


def test_insight_rules(fake):
    p = fake(rows=1000, missing=12.0, dup=6.0, columns=[
        ("one", "number", 0, 1), ("two", "number", 0, 2), ("flag", "boolean", 0, 2), ("few", "number", 0, 5), ("none", "number", 1000, 0), ("id", "string", 0, 950),
        ("gap", "number", 200, 600), ("hole", "number", 400, 500)],
        pairs=[("a", "b", -0.95), ("a", "c", 0.7), ("b", "c", 0.55), ("c", "d", 0.3)], bins=[("u", (100, 9)), ("v", (10, 9)), ("w", (5,))])
    got = {r["rule"]: (r["severity"], r["evidence"]) for r in insights(p).collect()}
    assert got["missing_tier"][0] == "critical" and got["duplicate_tier"][0] == "critical" and got["size_tier"][0] == "info"
    assert got["missing_column"] == ("warning", ["gap"]) and got["missing_columns_critical"] == ("critical", ["none", "hole"])
    assert got["constant_columns"][1] == ["one"] and got["binary_columns"][1] == ["two"] and got["low_card_numeric"][1] == ["few", "none"]
    assert got["id_like_columns"][1] == ["id"] and got["skewed_distributions"][1] == ["u"] and got["feature_diversity"][0] == "info"
    assert got["corr_very_strong"][1] == ["a / b"] and got["corr_strong"][1] == ["a / c"] and got["corr_moderate"][1] == ["b / c"]


@pytest.mark.parametrize("counts, severity", [((9, 1), "high"), ((8, 2), "high"), ((7, 3), "medium"), ((5, 5), None), ((4, 0), None)])
def test_class_imbalance(make, counts, severity):
    df = make([("a",)] * counts[0] + [("b",)] * counts[1] + [(None,)], "y string")
    row = B.class_imbalance(df, "y").first()
    assert (row["severity"] if row else None) == severity


def test_bias_figures(make):
    rows = [(float(i), 0.0 if i < 98 else 1.0, 10.0 ** (i / 10) if i > 80 else 1.0 + i / 1000, 3.0) for i in range(100)]
    df = make(rows, "lin double, rare double, tail double, flat double")
    got = {(r["type"], r["severity"]): r["affected_columns"] for r in B.bias_warnings(df, "t").collect()}
    assert got[("feature_skewness", "high")] == ["rare", "tail"] and got[("outlier_heavy", "medium")] == ["tail"]
    assert got[("low_variance", "medium")] == ["rare", "flat"]


@pytest.mark.parametrize("flat, fires", [(1, False), (2, False), (3, True)])
def test_dominance_needs_more_than_three_to_one(make, flat, fires):
    df = make([tuple([float(i)] + [1.0] * flat) for i in range(6)], "v double, " + ", ".join(f"f{i} double" for i in range(flat)))
    assert (B.dominance(df).count() == 1) == fires


def test_proxy_names(make):
    df = make([(1, 1, 1, 1)], "`Post-Al` int, zip_code int, page_id int, plain int")
    assert B.proxy(df).first()["affected_columns"] == ["Post-Al", "zip_code", "page_id"]


def test_few_rows_give_no_numeric_warning(make):
    assert B.bias_warnings(make([(float(i),) for i in range(9)], "x double"), "t").count() == 0


@pytest.mark.parametrize("rows, ddl, task, target", [
    ([("2024-01-01", 1.0)] * 3, "day string, v double", "time-series", "v"),
    ([("x" * 60, "a")] * 3, "body string, kind string", "classification", "kind"),
    ([(1.5, "a"), (2.5, "b")], "v double, status string", "classification", "status"),
    ([(float(i), float(i)) for i in range(30)], "a double, price double", "regression", "price"),
    ([(float(i % 3), float(i)) for i in range(30)], "rating double, k double", "classification", "rating"),
    ([(float(i), float(i), float(i), f"w{i}") for i in range(60)], "a double, b double, c double, d string", "clustering", None),
    ([(float(i), f"w{i}") for i in range(60)], "a double, d string", "classification", None)])
def test_recommendation(make, rows, ddl, task, target):
    row = recommend(column_roles(make(rows, ddl))).first()
    assert (row["task"], row["target"]) == (task, target)


def test_mixed_layouts_are_no_time_column(make):
    roles = column_roles(make([("01/31/2024",), ("2024-01-02",)], "d string"))
    assert roles.first()["role"] == "low_cardinality"


def test_domain_ties_go_to_the_earlier_one(spark):
    cols = local_table(spark, [{"dataset_id": "t", "position": 0, "name": "Price_user"}], "dataset_id string, position int, name string")
    assert detect_domain(cols).first()["domain"] == "finance"
    none = local_table(spark, [{"dataset_id": "t", "position": 0, "name": "zzz"}], "dataset_id string, position int, name string")
    assert detect_domain(none).first()["domain"] == ""


def test_lookups(spark):
    row = spark.range(1).select(use_cases(F.lit("clustering"), F.lit("sports")).alias("a"), use_cases(F.lit("regression"), F.lit("demand")).alias("b"),
                                class_models(F.lit(2)).alias("m"), class_models(F.lit(11)).alias("n")).first()
    assert row["a"] == ["data grouping", "similarity analysis", "unsupervised pattern mining"] and len(row["b"]) == 5 and row["b"][0] == "demand forecasting"
    assert row["m"][0] == "Logistic Regression" and row["n"][0] == "XGBoost"


def test_target_falls_back_to_the_last_column(make):
    got = detect_target(column_roles(make([(float(i), float(i % 3)) for i in range(20)], "a double, b double"))).first()
    assert (got["target"], got["is_categorical"]) == ("b", True)


def test_analysis_and_comparison(make):
    small = make([(i % 4, "u", None if i % 3 else 1.0) for i in range(40)], "n int, label string, g double")
    large = make([(i, f"v{i % 5}", float(i)) for i in range(400)], "n int, label string, g double")
    a = analyze({"small": small, "large": large})
    steps = {r["dataset_id"]: [x["action_key"] for x in a.next_steps.where(F.col("dataset_id") == r["dataset_id"]).orderBy("ord").collect()]
             for r in a.profile.metrics.collect()}
    assert steps["small"][:2] == ["handle_missing", "remove_duplicates"] and "drop_low_variance" in steps["small"]
    assert steps["large"][-3:] == [None, None, None]
    s = dataset_summary(a.profile, a.recommendation)
    pairs = make([("large", "small")], "id_a string, id_b string")
    best = compare_winner(compare(s, pairs), s).first()
    assert best["best"] == "large" and best["points_a"] >= 6


def test_views(fake):
    p = fake(rows=10, columns=[("a", "number", 3, 5), ("b", "number", 0, 5)], bins=[("a", (1, 5, 5))])
    assert [(r["name"], r["pct"], r["band"]) for r in P.missing_map(p).orderBy("ord").collect()] == [("a", 30.0, "high"), ("b", 0.0, "none")]
    assert P.missing_map(fake(columns=[("a", "number", 0, 5)])).count() == 0
    assert P.distribution_summary(p).first()["modal_label"] == "1"


def test_chart_contract(make):
    df = make([(float(i), "x") for i in range(4)], "v double, s string")
    for bad in (lambda: C.check_columns(df, "histogram", ["nope"]), lambda: C.check_columns(df, "cube", ["v"]), lambda: C.scatter(df, "v", "s", "v"),
                lambda: C.violin(df, "v"), lambda: C.heatmap(df, ["v", "s"]), lambda: C.boxplot(df, ["s", "v"]), lambda: C.area(df, "s"),
                lambda: C.line(df, "v", "s", "v")):
        with pytest.raises(C.ChartError):
            bad()


def test_boolean_counts_as_category(make):
    bars, stats = C.histogram(make([(True,), (True,), (False,)], "b boolean"), "b")
    assert [(r["label"], r["count"]) for r in bars.orderBy("bin").collect()] == [("true", 2), ("false", 1)] and stats.first()["unique_values"] == 2


def test_suggestions(fake):
    p = fake(columns=[(f"n{i}", "number", i, 50) for i in range(5)] + [("cat", "string", 0, 4), ("wide", "string", 0, 11)],
             pairs=[("n0", "n1", -0.95), ("n0", "n2", 0.41), ("n1", "n2", 0.39)])
    got = [(r["chart_type"], r["columns"], r["priority"]) for r in C.suggest_charts(p).orderBy("ord").collect()]
    assert got[:5] == [("scatter", ["n0", "n1"], 95), ("heatmap", [f"n{i}" for i in range(5)], 70), ("pie", ["cat"], 60),
                       ("boxplot", ["n0", "n1", "n2", "n3"], 50), ("violin", ["n4"], 45)]
    assert len(got) == 8
