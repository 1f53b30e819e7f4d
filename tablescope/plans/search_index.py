"""A table of search queries in one plan, over an inverted index of the catalogue.

The index has a posting for every term of an entry's title, tags and description: (term, field, metadata score, entry). A keyword occurs in a
field exactly if one of the field's terms contains it, as keywords consist of the characters that terms consist of; the terms that contain a
keyword are found by the keyword's rarest pair of characters.

An entry without any keyword of a query gets a score that depends on the query's intent only. So the best such entries are ranked once for
each intent, and only entries that share a term with a query are scored for it - and of those only the ones that can still be
among its first k. The sizes of posting blocks (term, field, metadata score) prove for each query a relevance that k entries reach; a block is
read if an entry whose best field is the block's could reach as much, with every keyword in its favour. What is read is scored in full from
the catalogue, so results equal those of scoring every entry.

Queries without a keyword (punctuation, single letters, other scripts) score all entries alike but for titles that hold the query as a
whole; these titles are found by their characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.query_text import intent_score, query_intent, text_keywords
from ..session import materialize
from .rules import INTENT_WORDS
from .search import _moment, _tags, composite, dedup, filter_catalog, metadata_score, relevance_label

#: Points of a keyword by field, and the most that an entry can have of one keyword and of the whole query if its best field is this one.
FIELDS = {"title": (15, 32, 40), "tags": (12, 17, 0), "description": (5, 5, 0)}
TERM = "[a-z0-9-]+"
MOST_HITS = 200_000     # (keyword, term) rows that every task may hold
QUERIES_AT_ONCE = 2_000 # of a task that puts the terms of queries together


def _fields() -> dict[str, Column]:
    return {"title": F.lower("title"), "tags": F.lower(F.array_join(_tags(), " ")), "description": F.lower(F.coalesce("description", F.lit("")))}


def _everything() -> Column:
    return F.concat_ws(" ", F.col("title"), F.coalesce("description", F.lit("")), F.array_join(_tags(), " "))


def keyword_points(query: Column, keywords: Column) -> Column:
    """0-100 by where a query and its keywords occur in an entry; 50 without keywords."""
    title, tags, text = _fields().values()
    points = F.aggregate(keywords, F.lit(0.0), lambda total, k: total + F.contains(title, k).cast("double") * 15
                         + F.contains(tags, k).cast("double") * 12 + F.contains(text, k).cast("double") * 5)
    total = F.contains(title, F.lower(query)).cast("double") * 40 + points
    return F.when(F.size(keywords) == 0, 50.0).otherwise(F.least(F.lit(100.0), total / (40 + F.size(keywords) * 32) * 100))


@dataclass
class SearchIndex:
    entries: DataFrame      # the deduplicated catalogue with ``metadata``
    postings: DataFrame     # term, field, metadata, entry
    blocks: DataFrame       # term, field, metadata, n
    grams: DataFrame        # gram, term: the distinct character pairs of each term


def build_index(catalog: DataFrame, as_of: Column | str | None = None, arrival: str = "id", source: list[str] | None = None) -> SearchIndex:
    if source:
        catalog = catalog.where(F.col("source").isin(source))
    entries = materialize(dedup(catalog, arrival).withColumn("metadata", metadata_score(as_of)), "entries")
    terms = F.array(*[F.struct(F.lit(f).alias("field"), F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("terms"))
                      for f, text in _fields().items()])
    fields = entries.select(F.col("id").alias("entry"), "metadata", F.explode(terms).alias("f"))
    postings = materialize(fields.select(F.explode("f.terms").alias("term"), F.col("f.field").alias("field"), "metadata", "entry"), "postings")
    blocks = materialize(postings.groupBy("term", "field", "metadata").agg(F.count("*").alias("n")), "blocks")
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("term") - 1), lambda i: F.substring(F.col("term"), i, F.lit(2))))
    grams = materialize(blocks.select("term").distinct().where(F.length("term") > 1).select(F.explode(pairs).alias("gram"), "term"), "grams")
    return SearchIndex(entries, postings, blocks, grams)


def _asked(queries: DataFrame, query_id: str, query: str) -> DataFrame:
    q = F.col(query)
    return queries.select(F.col(query_id).alias("qid"), q.alias("q"), F.coalesce(text_keywords(q), F.array().cast("array<string>")).alias("keywords"), query_intent(q).alias("intent"))


def keyword_terms(asked: DataFrame, grams: DataFrame) -> DataFrame:
    """(keyword, term): the terms that contain each keyword."""
    words = asked.select(F.explode("keywords").alias("keyword")).distinct()
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("keyword") - 1), lambda i: F.substring(F.col("keyword"), i, F.lit(2))))
    common = materialize(grams.groupBy("gram").agg(F.count("*").alias("n")), "gram-counts")
    each = words.select("keyword", F.explode(pairs).alias("g"))
    # A pair that no term has proves that there is no such term.
    counted = each.join(common, F.col("g") == F.col("gram"), "left").groupBy("keyword").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("g").alias("g"))).alias("rarest")).where("rarest.n > 0").select("keyword", F.col("rarest.g").alias("g"))
    return materialize(counted, "rarest").join(grams, F.col("g") == F.col("gram")).where(F.contains("term", F.col("keyword"))).select("keyword", "term")


def _class(keywords: Column, intent: Column, blank: Column) -> Column:
    """What entries without a shared term are scored by."""
    return F.when(blank, "blank").when(F.size(keywords) == 0, "none").otherwise(F.concat(F.lit("intent "), F.coalesce(intent, F.lit(""))))


def _others(entries: DataFrame, depth: int) -> DataFrame:
    """(class, entry, relevance, place): the first ``depth`` entries of each class as if they shared no term with the query."""
    kinds = [("blank", F.lit(50.0), None), ("none", F.lit(50.0), None), ("intent ", F.lit(0.0), None),
             *[(f"intent {name}", F.lit(0.0), name) for name in INTENT_WORDS]]
    text = _everything()
    each = F.array(*[F.struct(F.lit(kind).alias("class"), composite(F.lit(0.0), keyword, F.col("metadata"), intent_score(text, F.lit(name).cast("string")),
                                                                  F.lit(kind == "blank")).alias("relevance")) for kind, keyword, name in kinds])
    rows = entries.select(F.col("id").alias("entry"), F.explode(each).alias("e")).select("entry", "e.class", "e.relevance")
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("relevance"), "entry"))      # cut to ``depth`` before the shuffle
    return rows.withColumn("place", place).where(F.col("place") <= depth)


def _candidates(index: SearchIndex, asked: DataFrame, k: int | None) -> DataFrame:
    """(qid, entry): entries that share a term with a query, without those that ``k`` others certainly surpass (None: all)."""
    words = asked.select("qid", "intent", F.lower("q").alias("low"), F.size("keywords").alias("n_words"), F.explode("keywords").alias("keyword"))
    hits = materialize(keyword_terms(asked, index.grams), "keyword-terms")
    # The words of the queries are spread over the tasks, however few files the terms come from, and the terms of a query stay in one place.
    if hits.count() <= MOST_HITS:
        hits = F.broadcast(hits)
        words = words.repartition(max(asked.sparkSession.sparkContext.defaultParallelism, -(-asked.count() // QUERIES_AT_ONCE)), "qid")
    else:
        hits = hits.hint("merge")
    # Where the query is the keyword itself, a title with the keyword holds the whole query.
    read = materialize(words.join(hits, "keyword").groupBy("qid", "intent", "n_words", "term").agg(F.max(F.col("low") == F.col("keyword")).alias("whole")), "query-terms")
    blocks = read.join(index.blocks, "term")
    if k is not None:
        most = 40 + F.col("n_words") * 32
        by_field = lambda at: F.create_map(*[x for f, v in FIELDS.items() for x in (F.lit(f), F.lit(v[at]))])[F.col("field")]     # noqa: E731
        none = F.lit(0.0)
        hit = F.col("field") == "title"
        sure = F.col("whole") & hit
        least = composite(none, F.least(F.lit(100.0), (by_field(0) + F.when(sure, 40).otherwise(0)) / most * 100), F.col("metadata"), none, sure)
        best = composite(none, F.least(F.lit(100.0), (by_field(1) * F.col("n_words") + by_field(2)) / most * 100), F.col("metadata"),
                         F.when(F.col("intent").isNull(), 0.0).otherwise(100.0), hit)
        blocks = materialize(blocks.withColumn("least", least).withColumn("best", best), "query-blocks")
        # Entries of one term and field are distinct, so the sizes of its blocks add up.
        upto = F.sum("n").over(Window.partitionBy("qid", "term", "field").orderBy(F.desc("metadata")))      # one row for each metadata score
        proven = (blocks.withColumn("upto", upto).where(F.col("upto") >= k).groupBy("qid").agg(F.max("least").alias("proven"))
                  .withColumnRenamed("qid", "p"))
        blocks = blocks.join(proven, F.col("qid") == F.col("p"), "left").where(F.col("best") >= F.coalesce("proven", F.lit(0.0)))
    wanted = materialize(blocks.select("qid", "term", "field", "metadata"), "wanted")
    return wanted.join(index.postings, ["term", "field", "metadata"]).select("qid", "entry").distinct()


def _whole_titles(index: SearchIndex, asked: DataFrame) -> DataFrame:
    """(qid, entry): titles that hold a query which has no keyword."""
    bare = asked.where(F.size("keywords") == 0).select("qid", F.lower(F.trim("q")).alias("text")).where("text <> ''")
    first = bare.select("qid", "text", F.substring("text", 1, 1).alias("c"))
    titles = index.entries.select(F.col("id").alias("entry"), F.lower("title").alias("title")).select(
        "entry", "title", F.explode(F.array_distinct(F.split("title", ""))).alias("d"))
    return titles.join(first, F.col("c") == F.col("d")).where(F.contains("title", F.col("text"))).select("qid", "entry")


def search_batch(index: SearchIndex, queries: DataFrame, query_id: str, query: str, limit: int = 20, page: int = 1, filters: dict | None = None,
                 as_of: Column | str | None = None) -> DataFrame:
    """(query id, rank, id, title, keyword, metadata, intent, relevance, quality): one page for each query, ties to the smaller id.

    ``filters`` hold for all queries, as in ``filter_catalog``; a filter on ``quality`` reads all blocks, as better entries may be filtered out, and
    deepens the ranking of the other entries until every page is certain.
    """
    filters = {k: v for k, v in (filters or {}).items() if k != "source"}
    quality = filters.pop("quality", None)
    as_of = _moment(as_of)
    entries = filter_catalog(index.entries, as_of=as_of, **filters)
    if filters:
        kept = materialize(entries.select(F.col("id").alias("entry")), "kept")
        postings = materialize(index.postings.join(kept, "entry", "left_semi"), "postings")
        index = SearchIndex(entries, postings, materialize(postings.groupBy("term", "field", "metadata").agg(F.count("*").alias("n")), "blocks"), index.grams)
    asked = materialize(_asked(queries, query_id, query), "asked")
    k = page * limit
    label = relevance_label(F.col("relevance"))
    accept = label.isin(quality) if quality else F.lit(True)
    pairs = materialize(_candidates(index, asked, None if quality else k).unionByName(_whole_titles(index, asked)).distinct(), "candidates")
    hit = F.contains(F.lower("title"), F.lower(F.trim("q")))
    columns = ["qid", "entry", "title", "keyword", "metadata", "intent", "relevance"]

    def scored(found: DataFrame) -> DataFrame:
        wide = found.join(asked.withColumnRenamed("intent", "wants"), "qid").join(entries, F.col("entry") == F.col("id")).withColumns(
            {"keyword": keyword_points(F.col("q"), F.col("keywords")), "intent": intent_score(_everything(), F.col("wants"))})
        return wide.withColumn("relevance", composite(F.lit(0.0), F.col("keyword"), F.col("metadata"), F.col("intent"), hit)).select(*columns)

    shared = materialize(scored(pairs).where(accept), "scored")
    kinds = asked.select("qid", _class(F.col("keywords"), F.col("intent"), F.trim("q") == "").alias("class"))
    depth, order = k, Window.partitionBy("qid").orderBy(F.desc("relevance"), "entry")
    total = entries.count()
    while True:
        rest = materialize(_others(entries, depth), "others")
        # An entry of both kinds counts with the score it really has.
        others = kinds.join(rest, "class").select("qid", "entry").join(pairs, ["qid", "entry"], "left_anti")
        ranked = shared.unionByName(scored(others).where(accept)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if not quality or depth >= total:
            break
        ranked = materialize(ranked, "ranked")
        short = asked.join(ranked.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").where(F.coalesce("n", F.lit(0)) < k)
        if not short.limit(1).count():
            break
        depth *= 4
    out = ranked.where(F.col("rank") > k - limit).withColumn("quality", label)
    return out.select(F.col("qid").alias(query_id), "rank", F.col("entry").alias("id"), "title", "keyword", "metadata", "intent", "relevance", "quality")
