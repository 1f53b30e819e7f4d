"""Values, columns and records beyond what the reference admits."""

import json

import pytest

from pyspark.sql import functions as F
from tablescope.functions.numeric import rounded_value
from tablescope.functions.text import format_number
from tablescope.operators.augment import _copies, smote
from tablescope.operators.charts import ChartError, boxplot, heatmap, histogram
from tablescope.operators.encode import encode_label
from tablescope.operators.profile import profile
from tablescope.sources.catalog import normalize_github, normalize_huggingface, normalize_kaggle


@pytest.mark.parametrize("scale", [1e17, 1e29, 1e36, 1e300])
def test_large_numbers(spark, scale):
    df = spark.range(50).select((F.col("id") * F.lit(scale)).alias("x"), F.col("id").cast("double").alias("y"))
    assert rounded_value(scale, 4) == scale
    assert profile(df, "t").columns.count() == 2
    points, stats = histogram(df, "x")
    assert points.count() > 0 and stats.count() == 1 and boxplot(df, ["x", "y"]).count() == 2
    text = spark.range(1).select(format_number(F.lit(scale)).alias("t")).first()[0]
    assert text.endswith("M") and float(text[:-1]) * 1e6 == pytest.approx(scale)


def test_too_many_chart_columns_are_refused(make):
    df = make([tuple(float(i + j) for j in range(13)) for i in range(9)], ", ".join(f"c{i} double" for i in range(13)))
    with pytest.raises(ChartError):
        boxplot(df, df.columns[:6])
    with pytest.raises(ChartError):
        heatmap(df, df.columns)


def test_catalogue_records_are_whole(spark):
    text, tags = "d" * 900, [f"t{i}" for i in range(30)]
    one = lambda **r: spark.createDataFrame([(json.dumps(r),)], "record string")        # noqa: E731
    assert normalize_kaggle(one(ref="a/b", totalBytes=1 << 40)).first()["size_bytes"] == 1 << 40
    assert normalize_kaggle(one(ref="a/b", totalBytes=1 << 40), max_bytes=1 << 30).count() == 0
    hub = one(id="a/b", description=text, tags=tags)
    assert (len(normalize_huggingface(hub).first()["description"]), len(normalize_huggingface(hub).first()["tags"])) == (900, 30)
    assert len(normalize_huggingface(hub, description_chars=500, max_tags=10).first()["tags"]) == 10
    git = normalize_github(one(full_name="a/b", name="b", description=text, topics=tags, size=1 << 30)).first()
    assert (len(git["description"]), len(git["tags"]), git["size_bytes"]) == (900, 30, 1 << 40)


def test_dictionaries_are_learnt_from_the_input(make):
    out = encode_label(make([("b", "x", 1), ("a", None, 2), ("b", "y", 3)], "p string, q string, n int"))
    assert sorted(map(tuple, out.collect()), key=lambda r: r[2]) == [(1, 1, 1), (0, 0, 2), (1, 2, 3)]


def test_few_rows_against_many(spark):
    """Three rows of a class are brought to 200,000 without a row that holds all draws."""
    many = spark.range(200_000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.lit("many").alias("y"))
    few = spark.createDataFrame([(1.0, 1.0, "few"), (2.0, 5.0, "few"), (3.0, 2.0, "few")], "a double, b double, y string")
    out = smote(many.unionByName(few), "y")
    got = out.where("y = 'few'")
    assert got.count() == 200_000 and got.where("a between 1 and 3 and b between 1 and 5").count() == 200_000
    draws = _copies(spark.createDataFrame([("g", 25_001), ("h", 0), ("i", 1)], "grp string, draws bigint"), ["grp"])
    assert {r["grp"]: r["count"] for r in draws.groupBy("grp").count().collect()} == {"g": 25_001, "i": 1}
    assert draws.distinct().count() == 25_002 and draws.where("copy between 1 and draws").count() == 25_002
