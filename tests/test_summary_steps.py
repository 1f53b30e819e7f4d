"""Column roles and dates: what is known is not learnt again, what is no date is not parsed."""

from pyspark.sql import functions as F

from tablescope.operators.profile import DATE_FORMATS, looks_like_date, maybe_date
from tablescope.plans import recommend as R
from tablescope.queries import judge


def test_texts_that_cannot_be_dates_are_not_parsed(make):
    dates = ["2024-01-02", " \t2024-01-02 10:11:12", "+2024-01-02", "T10:11:12", "10:11", "September 5, 2024", "5 Sep 2024", "Sep 5, 2024", "1/2/2024",
             "1-2-2024", "2024/1/2", "2.1.2024", "20240102", "2024-01-02 00:00:00." + "0" * 300]
    prose = ["A long text without a number near its start, but 2024 later", "", "September", None]
    df = make([(v,) for v in dates + prose], "v string")
    plain = F.lit(False)
    for test in [F.col("v").try_cast("timestamp").isNotNull(), *[F.try_to_timestamp("v", F.lit(f)).isNotNull() for f in DATE_FORMATS]]:
        plain = plain | test
    got = df.select("v", looks_like_date(F.col("v")).alias("date"), plain.alias("plain"), maybe_date(F.col("v")).alias("tried")).collect()
    assert all(r["date"] == r["plain"] for r in got) and sum(r["date"] for r in got) >= len(dates) - 1
    assert [r["v"] for r in got if not r["tried"]] == prose


def test_summary_does_not_count_again_what_the_profile_holds(spark, make, tmp_path, monkeypatch):
    n = 40
    make([(i // 2, i, i % 5, i % 2 + 1, float(i % 9), i * 1.5, 0.1 * (i % 3), 0.02, "A" if i % 3 else "N", "F", "1995-01-02") for i in range(n)],
         "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
         "l_tax double, l_returnflag string, l_linestatus string, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    make([(i, i % 7, "O" if i % 2 else "F", i * 10.0, "1995-01-02", "LOW") for i in range(n)],
         "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    make([(i, f"text {i % 6}", "en", "web", 6) for i in range(n)], "doc_id bigint, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    make([(i, i % 2, 0) for i in range(n)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = {r["dataset_id"]: (r["task"], r["target"]) for r in R.recommend(judge.roles(spark, str(tmp_path))).collect()}
    judge._CACHE.pop((spark.sparkContext.applicationId, str(tmp_path), "roles"))
    monkeypatch.setattr(R, "distinct_counts", None)
    got = judge.QUERIES["dataset_summary"][0](spark, str(tmp_path)).collect()
    assert {r["dataset_id"]: (r["task"], r["target"]) for r in got} == want and len(want) == 4
