"""Rank a catalogue of dataset descriptions against a query.

Keywords and intent of the query are worked out once and become literals, so
scoring a catalogue is a single projection followed by a distributed top-k.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..functions.query_text import intent_score, query_expand, query_intent, text_keywords, text_sanitize
from ..functions.text import age_days
from ..functions.vectors import cosine, literal_vector
from ..operators.similarity import SimilarityIndex, top_k
from ..session import local_table

MB, GB = 1024 ** 2, 1024 ** 3
BLOCK_DONORS, BLOCK_QUERIES = 8_192, 1_024      # vectors and queries of one block of the similarity search
FRESH_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def _moment(as_of: Column | str | None) -> Column:
    """The reference time of ages: a timestamp column or text, the query time by default."""
    if as_of is None:
        return F.current_timestamp()
    return (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp")


def _tags(c: Column | None = None) -> Column:
    return F.coalesce(c if c is not None else F.col("tags"), F.array().cast("array<string>"))


@dataclass
class QueryFacts:
    """What a query asks for; worked out once, then used as literals."""

    text: str
    keywords: list[str]
    intent: str | None


def query_facts(spark: SparkSession, query: str) -> QueryFacts:
    q = F.col("q")
    row = local_table(spark, [{"q": query}], "q string").select(text_keywords(q).alias("k"), query_intent(q).alias("i")).first()
    return QueryFacts(query, list(row["k"]), row["i"])


def keyword_score(facts: QueryFacts) -> Column:
    """0-100 by where the query and its keywords occur; 50 without keywords."""
    if not facts.keywords:
        return F.lit(50.0)
    title, text = F.lower("title"), F.lower(F.coalesce("description", F.lit("")))
    tags = F.lower(F.array_join(_tags(), " "))
    total = F.contains(title, F.lit(facts.text.lower())).cast("double") * 40
    for k in facts.keywords:
        for where, points in ((title, 15), (tags, 12), (text, 5)):
            total = total + F.contains(where, F.lit(k.lower())).cast("double") * points
    return F.least(F.lit(100.0), total / (40 + len(facts.keywords) * 32) * 100)


def _known(c: str) -> Column:
    return F.coalesce((F.col(c) != "") & (F.col(c) != "Unknown"), F.lit(False))


def metadata_score(as_of: Column | str | None = None) -> Column:
    """0-100 for complete and fresh catalogue entries."""
    days = age_days(F.col("last_updated"), _moment(as_of))
    # One reference to the age: 0 for up to 30 days, 1 up to 90, 2 up to 365, 3 beyond or unknown.
    step = F.size(F.filter(F.array(F.lit(30), F.lit(90), F.lit(365)), lambda most: ~F.coalesce(days <= most, F.lit(False))))
    fresh = F.get(F.array(F.lit(25), F.lit(20), F.lit(10), F.lit(5)), step)
    dated = F.coalesce(F.col("last_updated") != "", F.lit(False))
    return (F.when(F.length("description") > 20, 20).otherwise(0) + F.when(F.size(_tags()) >= 2, 20).otherwise(0)
            + F.when(F.col("size_bytes") > 0, 15).otherwise(0) + F.when(_known("author"), 10).otherwise(0)
            + F.when(_known("license"), 10).otherwise(0) + F.when(dated, fresh).otherwise(0)).cast("double")


def metadata_richness() -> Column:
    return (F.when(F.length("description") > 20, 2).otherwise(0) + F.when(F.size(_tags()) > 0, 1).otherwise(0)
            + F.when(F.col("size_bytes") > 0, 1).otherwise(0) + F.when(_known("author"), 1).otherwise(0)
            + F.when(F.col("source") == "kaggle", 1).otherwise(0))


def title_key(title: Column) -> Column:
    """What is left of a title without source and format words and punctuation."""
    plain = F.regexp_replace(F.lower(F.trim(title)), r"\b(dataset|data|csv|kaggle|huggingface|github)\b", "")
    return F.regexp_replace(plain, "[^a-z0-9]", "")


def dedup(catalog: DataFrame, arrival: str = "id") -> DataFrame:
    """Of entries with the same title key keep the richest, the earliest on ties.

    A minimum per key is combined map-side, so a title shared by a third of the
    catalogue is no problem. Entries whose key is empty are all kept.
    """
    rest = [c for c in catalog.columns]
    key = title_key(F.col("title"))
    keyed = catalog.withColumn("title_key", key)
    order = F.struct((-metadata_richness()).alias("poor"), F.col(arrival).alias("at"))
    winners = (keyed.where(F.col("title_key") != "").groupBy("title_key").agg(F.min_by(F.struct(*rest), order).alias("best"))
               .select("best.*"))
    return winners.unionByName(catalog.where((key == "") | key.isNull()))


def _age_ok(days: int, as_of: Column) -> Column:
    age = age_days(F.col("last_updated"), as_of)
    return age.isNull() | (age <= days)


def filter_catalog(catalog: DataFrame, formats: list[str] | None = None, quality: list[str] | None = None, size: str | None = None,
                   freshness: str | None = None, source: list[str] | None = None, as_of: Column | str | None = None) -> DataFrame:
    """Unknown sizes and dates always pass; unknown bands filter nothing."""
    if formats:
        catalog = catalog.where(F.col("format").isin(formats))
    if source:
        catalog = catalog.where(F.col("source").isin(source))
    if quality:
        catalog = catalog.where(F.col("quality").isin(quality))
    b = F.col("size_bytes")
    band = {"small": b < 10 * MB, "medium": (b >= 10 * MB) & (b < GB), "large": b >= GB}.get(size or "")
    if band is not None:
        catalog = catalog.where((b == 0) | b.isNull() | band)
    if freshness in FRESH_DAYS:
        catalog = catalog.where(_age_ok(FRESH_DAYS[freshness], _moment(as_of)))
    return catalog


def relevance_label(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 45, "medium").otherwise("low")


def composite(semantic: Column, keyword: Column, metadata: Column, intent: Column, title_hit: Column) -> Column:
    """Weighted sum with floors 12, 20 (some keyword) and 35 (query in the title), 1 decimal."""
    raw = semantic * 0.50 + keyword * 0.25 + metadata * 0.15 + intent * 0.10
    floor = F.when(title_hit, 35.0).when(keyword > 0, 20.0).otherwise(12.0)
    return rounded(F.least(F.lit(100.0), F.greatest(floor, raw)), 1, bounded=True)


def score_catalog(catalog: DataFrame, query: str, query_vector=None, as_of: Column | str | None = None) -> DataFrame:
    """Adds semantic, keyword, metadata, intent, relevance and quality columns.

    Without a query vector or an ``embedding`` column the semantic part is 0.
    """
    facts = query_facts(catalog.sparkSession, query)
    everything = F.concat_ws(" ", F.col("title"), F.coalesce("description", F.lit("")), F.array_join(_tags(), " "))
    if query_vector is None or "embedding" not in catalog.columns:
        semantic = F.lit(0.0)
    else:
        semantic = F.greatest(F.lit(0.0), F.least(F.lit(100.0), cosine(F.col("embedding"), literal_vector(query_vector)) * 100))
    title_hit = F.contains(F.lower("title"), F.lit(query.lower().strip()))
    out = catalog.withColumns({
        "semantic": semantic, "keyword": keyword_score(facts), "metadata": metadata_score(as_of),
        "intent": intent_score(everything, F.lit(facts.intent).cast("string"))})
    out = out.withColumn("relevance", composite(F.col("semantic"), F.col("keyword"), F.col("metadata"), F.col("intent"), title_hit))
    return out.withColumn("quality", relevance_label(F.col("relevance")))


@dataclass
class Page:
    rows: DataFrame
    ranked: DataFrame
    limit: int

    @cached_property
    def total(self) -> int:
        """Number of matches; counted when asked for."""
        return self.ranked.count()

    @property
    def pages(self) -> int:
        return -(-self.total // self.limit)


def search(catalog: DataFrame, query: str, filters: dict | None = None, page: int = 1, limit: int = 20, query_vector=None,
           as_of: Column | str | None = None, arrival: str = "id") -> Page:
    """Deduplicate, score, label, filter, sort and cut one page; ties go to the smaller id."""
    ranked = ranked_catalog(catalog, query, filters, query_vector, as_of, arrival)
    rows = ranked.orderBy(F.desc("relevance"), "id").offset((page - 1) * limit).limit(limit)
    return Page(rows, ranked, limit)


def ranked_catalog(catalog: DataFrame, query: str, filters: dict | None = None, query_vector=None, as_of: Column | str | None = None,
                   arrival: str = "id") -> DataFrame:
    """Every matching entry with its scores, unsorted and unpaged."""
    filters = dict(filters or {})
    source = filters.get("source")
    if source:                                             # before anything is scored
        catalog = catalog.where(F.col("source").isin(source))
    scored = score_catalog(dedup(catalog, arrival), query, query_vector, as_of)
    return filter_catalog(scored, as_of=as_of, **filters)


def embedding_text(query: str, description: str | None = None) -> Column:
    """Text to embed for a query: its topic, the description, the expansion."""
    q = F.lit(query)
    topic = text_sanitize(q)
    wide = query_expand(topic, text_keywords(q))
    start = F.concat(topic, F.lit(f". {description}")) if description else topic
    return F.when(wide != topic, F.concat(start, F.lit(". "), wide)).otherwise(start)


# ---- vectors ------------------------------------------------------------------------

def fit_embedder(df: DataFrame, text_col: str, dims: int = 256):
    """The built-in embedder: TF-IDF weights learnt on ``df``, vectors of unit length."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims), IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit")]).fit(df)


def embed(df: DataFrame, text_col: str, output_col: str = "embedding", dims: int = 256, model=None) -> DataFrame:
    """Adds an ``array<double>`` vector per text; fits the embedder on ``df`` unless given one.

    A model's own vectors can be used instead: any ``array<float>`` column works.
    """
    from pyspark.ml.functions import vector_to_array

    model = model if model is not None else fit_embedder(df, text_col, dims)
    out = model.transform(df).withColumn(output_col, vector_to_array("_unit"))
    return out.drop("_words", "_tf", "_tfidf", "_unit")


def similarity_topk(docs: DataFrame, query_vector, k: int, vector_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """The k rows most similar to one vector; ties go to the smaller id."""
    scored = docs.withColumn("similarity", cosine(F.col(vector_col), literal_vector(query_vector)))
    return scored.orderBy(F.desc("similarity"), id_col).limit(k)


def similarity_topk_batch(queries: DataFrame, docs: DataFrame, k: int, query_id: str, doc_id: str, vector_col: str = "embedding") -> DataFrame:
    """(query id, doc id, similarity, rank) for a table of queries, by the exact pruned search of ``operators.similarity``."""
    index = SimilarityIndex(docs, doc_id, vector_col, block_queries=BLOCK_QUERIES, block_vectors=BLOCK_DONORS)
    return top_k(queries, docs, k, query_id, doc_id, vector_col, index)
