"""Inverted index and pruned similarity search against scoring everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.operators import similarity as S
from tablescope.plans import search as P
from tablescope.plans import search_index as X

AS_OF = "2024-06-30 00:00:00"
WORDS = ["sales", "wholesales", "forecast", "energy", "price", "patient", "records", "a-b", "time", "series", "übung", "日本", "predict", "market"]


@pytest.fixture(scope="module")
def catalog(spark):
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))      # noqa: E731
    rows = [(f"d{i:03d}", f"{text(rnd.randint(0, 4))} {i if i % 3 else ''}", None if i % 11 == 0 else text(rnd.randint(0, 12)),
             None if i % 13 == 0 else [text(1) for _ in range(rnd.randint(0, 3))], rnd.choice(["kaggle", "github"]), rnd.choice(["csv", "json"]),
             rnd.choice([0, 10, 10 ** 8]), rnd.choice(["", "2024-06-10T08:30:00Z", "2020-01-01T00:00:00Z"]), rnd.choice(["Unknown", "x"]), "mit") for i in range(220)]
    return spark.createDataFrame(rows, "id string, title string, description string, tags array<string>, source string, format string, size_bytes bigint, "
                                       "last_updated string, author string, license string").cache()


QUERIES = ["predict energy price", "Sales", "ales", "日本", "  ", "zzz unknown", "sales sales, patient records 14", "compare time series!"]


@pytest.mark.parametrize("limit,page,filters", [(5, 1, None), (7, 3, {"formats": ["csv"]}), (4, 2, {"quality": ["low"], "size": "small"})])
def test_batch_equals_single_searches(spark, catalog, limit, page, filters):
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "qid bigint, q string")
    index = X.build_index(catalog, AS_OF)
    got = {}
    for r in X.search_batch(index, asked, "qid", "q", limit, page, filters, AS_OF).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["id"], round(r["keyword"], 9), r["metadata"], r["intent"], r["relevance"], r["quality"]))
    every = index.entries.drop("metadata")
    for i, q in enumerate(QUERIES):
        facts = P.query_facts(spark, q)
        scored = P.filter_catalog(P.score_catalog(every, q, as_of=AS_OF), as_of=AS_OF, **(filters or {})).orderBy(F.desc("relevance"), "id").collect()
        want = [(r["id"], round(r["keyword"], 9), r["metadata"], r["intent"], r["relevance"], r["quality"]) for r in scored[(page - 1) * limit:page * limit]]
        assert got.get(i, []) == want, (q, facts)


def test_only_blocks_that_can_matter_are_read(spark):
    """A word in every description and in ten titles: the descriptions alone cannot reach the first ten, but the eleventh needs them."""
    rows = [(f"e{i:05d}", "common title" if i % 300 == 0 else f"other {i}", "a text with common words", ["t"], "kaggle", "csv", 5, "2024-06-10T08:30:00Z", "x", "mit") for i in range(3000)]
    catalog = spark.createDataFrame(rows, "id string, title string, description string, tags array<string>, source string, format string, size_bytes bigint, "
                                          "last_updated string, author string, license string").withColumn("title", F.concat("title", F.lit(" "), "id"))
    index = X.build_index(catalog, AS_OF)
    asked = X._asked(spark.createDataFrame([(1, "common")], "qid bigint, q string"), "qid", "q")
    assert X._candidates(index, asked, 10).count() == 10 and X._candidates(index, asked, 11).count() == 3000


def brute(q, x, k, ids):
    unit = lambda v: v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n)     # noqa: E731
    sims = np.round(unit(q) @ unit(x).T, 9) + 0.0
    return [sorted(zip(-row, ids))[:k] for row in sims]


@pytest.mark.parametrize("centres,ring", [(None, 512), (9, 5), (1, 20)])
def test_pruned_similarity_equals_brute_force(spark, centres, ring):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 6)), rng.normal(size=(200, 6)) * 0.1 + 3, np.zeros((2, 6)), np.ones((20, 6))])
    ids = [f"v{i:04d}" for i in range(len(x))]
    q = np.concatenate([x[::40], rng.normal(size=(5, 6)), -x[:1], np.zeros((1, 6))])
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + [("w0", None), ("w1", [1.0])], "name string, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "query string, embedding array<double>")
    index = S.SimilarityIndex(docs, "name", "embedding", centres, ring)
    got = {}
    for r in S.top_k(asked, docs, 7, "query", "name", index=index).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["name"], r["similarity"]))
    full = np.concatenate([x, np.zeros((2, 6))])
    for i, want in enumerate(brute(q, full, 7, [*ids, "w0", "w1"])):
        assert [n for n, _ in got[f"q{i}"]] == [n for _, n in want], i
        assert np.allclose([s for _, s in got[f"q{i}"]], [-s for s, _ in want], atol=2e-9)


def test_similarity_skips_blocks(spark):
    """Clustered vectors: a query visits few of the rings, and fewer than k documents are all found."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 16))
    x = np.repeat(centre, 100, axis=0) + rng.normal(size=(4000, 16)) * 0.05
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<float>")
    index = S.SimilarityIndex(docs, "id", "embedding", ring=50)
    asked = S._unit(docs.where("id % 100 = 0"), "id", "embedding", 16).withColumnRenamed("id", "qid")
    seen = S._ranked(index.visit(index.first(asked, 5), 5), 5).where("rank = 5")
    reach = asked.join(seen.select("qid", F.sqrt(2 - 2 * F.col("similarity")).alias("reach")), "qid")
    pairs = index.reached(reach).join(index.rings.select("ring", "n"), "ring")
    assert index.rings.count() >= 40 and pairs.agg(F.sum("n")).first()[0] < 0.15 * 4000 * 40
    small = docs.where("id < 3")
    assert S.top_k(small.withColumnRenamed("id", "q"), small, 5, "q", "id").count() == 9


def test_a_query_is_sent_once_to_a_cell(spark, monkeypatch):
    """Vectors in all directions, which no bound excludes, with copies: what is sent follows the blocks, not the rings."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(2400, 12)), np.repeat(rng.normal(size=(1, 12)), 300, axis=0)])
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>").repartition(4)
    asked = docs.where("id % 9 = 0 or id = 2500").select(F.col("id").alias("q"), "embedding")
    sent, meet = [], S.meet
    monkeypatch.setattr(S, "meet", lambda pairs, *more: sent.append(pairs.count()) or meet(pairs, *more))
    index = S.SimilarityIndex(docs, "id", "embedding", ring=20)
    rows = S.top_k(asked, docs, 6, "q", "id", index=index).orderBy("q", "rank").collect()
    ids = [r["q"] for r in asked.orderBy("q").collect()]
    assert index.rings.count() > 100 and sent[-1] <= 4 * len(ids)
    want = brute(x[ids], x, 6, list(range(len(x))))
    assert [[r["id"] for r in rows[6 * n:6 * n + 6]] for n in range(len(ids))] == [[i for _, i in w] for w in want]


def test_best_hits_settle_in_parts():
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(7, 4)), np.repeat(rng.normal(size=(30, 4)), 3, axis=0)
    best = S._Best(q, x, np.arange(90)[::-1], 5, np.full(7, -np.inf))
    for at in range(0, 90, 10):
        i, j = (c.ravel() for c in np.meshgrid(np.arange(7), np.arange(at, at + 10), indexing="ij"))
        some = (q @ x.T)[i, j] >= best.floor[i] - S.SLACK
        best.add(i[some], j[some], (q @ x.T)[i, j][some])
        best.settle()
    for i in range(7):
        assert best.j[best.i == i].tolist() == sorted(range(90), key=lambda j: (-round(float(q[i] @ x[j]), 9), -j))[:5]


@pytest.mark.parametrize("most", [0, 200_000])
def test_words_of_queries_are_not_sent_to_every_task(spark, monkeypatch, most):
    """Few terms in one file, many queries: the terms go to the queries, of which a task has a bounded number."""
    rows = [(f"e{i}", f"common title {i}", "a text with words", ["t"], "kaggle", "csv", 5, "2024-06-10T08:30:00Z", "x", "mit") for i in range(20)]
    catalog = spark.createDataFrame(rows, "id string, title string, description string, tags array<string>, source string, format string, size_bytes bigint, "
                                          "last_updated string, author string, license string")
    index = X.build_index(catalog, AS_OF)
    asked = X.materialize(X._asked(spark.range(300).select(F.col("id").alias("qid"), F.lit("common words").alias("q")), "qid", "q"), "asked")
    plans, keep = [], X.materialize
    monkeypatch.setattr(X, "MOST_HITS", most)
    monkeypatch.setattr(X, "QUERIES_AT_ONCE", 10)
    monkeypatch.setattr(X, "materialize", lambda df, label: label == "query-terms" and plans.append((df, df._jdf.queryExecution().executedPlan().toString())) or keep(df, label))
    assert X._candidates(index, asked, None).count() == 300 * 20
    [(df, plan)] = plans
    assert not most or df.rdd.getNumPartitions() == 30
    assert ("SortMergeJoin" in plan) == (most == 0) and ("hashpartitioning(qid" in plan)
