"""Search and text queries over a catalogue derived from the documents table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import query_text as Q
from ..functions import text as X
from ..functions.numeric import rounded
from ..functions.vectors import cosine
from ..plans import search as P
from ..plans.rules import INTENT_WORDS, INTENTS, NOISE_WORDS, STOP_WORDS, SYNONYMS
from .base import big, derived, duck, fmt_number, fx, r, read, tidy

AS_OF = "2024-06-30 00:00:00"

# One entry per document; titles repeat up to noise words, dates carry a zone, none, or are empty.
CATALOG = """
select concat('d', cast(doc_id as {text})) as id,
       concat(case when doc_id % 3 = 0 then 'Sales forecast ' when doc_id % 3 = 1 then 'Weather data ' else 'Patient records dataset ' end,
              source, case when doc_id % 4 = 0 then ' CSV' else '' end) as title,
       text as description, case when doc_id % 3 = 0 then 'kaggle' when doc_id % 3 = 1 then 'github' else 'huggingface' end as source,
       case when doc_id % 5 = 0 then 'json' else 'csv' end as format, cast(n_chars as bigint) * (doc_id % 7) * 40000 as size_bytes,
       case when doc_id % 6 = 0 then '' when doc_id % 6 = 1 then '2024-06-10T08:30:00Z' when doc_id % 6 = 2 then '2024-04-20T00:00:00+00:00'
            when doc_id % 6 = 3 then '2023-09-01T12:00:00Z' when doc_id % 6 = 4 then '2020-01-01T00:00:00Z' else '2024-06-01T00:00:00' end as last_updated,
       case when doc_id % 4 = 1 then 'Unknown' else source end as author, case when doc_id % 5 = 2 then 'Unknown' else 'mit' end as license, doc_id as arrival,
       {tags} as tags
from {documents}"""
_SPARK = (CATALOG.replace("{text}", "string")
          .replace("{tags}", "case when doc_id % 2 = 0 then array(lang, source, 'prediction') else array(lang) end"))
_DUCK = "(" + duck(CATALOG.replace("{text}", "varchar").replace("{tags}", "case when doc_id % 2 = 0 then [lang, source, 'prediction'] else [lang] end")) + ")"
QUERY = "Find sales dataset to predict revenue"

# Query texts: whole benchmark texts, and catalogue titles with a verb in front.
QUERIES_TEXT = """
select concat('b', cast(item_id as {text})) as qid, text as q from {benchmark}
union all select concat('u', cast(page_id as {text})), concat(case when page_id % 4 = 0 then 'Predict energy and ' when page_id % 4 = 1 then 'the best data set '
  when page_id % 4 = 2 then 'Stock market time series, compare: ' else 'a csv file of ' end, case when page_id % 5 = 0 then '' else url end) from {pages}"""


def _catalog(s, d):
    return derived(s, d, _SPARK)


def _texts(s, d):
    return derived(s, d, QUERIES_TEXT.replace("{text}", "string"))


_T = "(" + duck(QUERIES_TEXT.replace("{text}", "varchar")) + ")"


def _l(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _norm(x):
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s\\-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _words(x):
    return f"list_filter(string_split({_norm(x)}, ' '), lambda w: length(w) > 1)"


def _minus(words, gone):
    return f"list_filter({words}, lambda w: not list_contains({_l(gone)}, w))"


_BOTH = list(dict.fromkeys(NOISE_WORDS + STOP_WORDS))


def _keywords(x):
    a, b = _minus(_words(x), _BOTH), _minus(_words(x), STOP_WORDS)
    return f"case when len({a}) > 0 then {a} when len({b}) > 0 then {b} else {_words(x)}[1:5] end"


def _sanitize(x):
    a, b = _minus(_words(x), _BOTH), _minus(_words(x), NOISE_WORDS)
    return f"case when len({a}) > 0 then array_to_string({a}, ' ') when len({b}) > 0 then array_to_string({b}, ' ') else {_norm(x)} end"


_SYN = "(" + " union all ".join(f"select {i} as n, '{t}' as term, '{w}' as syn, {j} as m" for i, (t, two) in enumerate(SYNONYMS.items()) for j, w in enumerate(two)) + ")"
_EXPAND = f"""with q as (select qid, {_sanitize('q')} as s, {_keywords('q')} as k from {_T} t),
f as (select qid, syn, min(n * 2 + m) as place from q join {_SYN} y on contains(lower(s), term) or list_contains(k, term) where not contains(lower(s), syn) group by 1, 2),
g as (select *, row_number() over (partition by qid order by place) as rn from f)
select q.qid, case when count(g.syn) > 0 then any_value(q.s) || ' ' || string_agg(g.syn, ' ' order by rn) else any_value(q.s) end as expanded
from q left join g on q.qid = g.qid and rn <= 4 group by q.qid"""
_INTENT = "case " + " ".join(f"when contains(lower({{x}}), '{v}') then '{i}'" for v, i in INTENTS.items()) + " end"


def _intent_score(text, intent):
    rel = "case " + intent + " " + " ".join(f"when '{n}' then " + " + ".join(f"cast(contains(lower({text}), '{w}') as int)" for w in words) for n, words in INTENT_WORDS.items()) + " else 0 end"
    return f"case when {intent} is null then 0.0 when contains(lower({text}), {intent}) then 80.0 else least(100.0, ({rel}) * 25.0) end"


_AGE = (f"case when regexp_matches(last_updated, '[T ][0-9]{{2}}:[0-9]{{2}}.*(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') then cast(floor((epoch_us(timestamp '{AS_OF}') - "
        "epoch_us(cast(try_cast(last_updated as timestamptz) as timestamp))) / 86400000000.0) as bigint) end")
_META = f"""cast(case when length(description) > 20 then 20 else 0 end + case when len(tags) >= 2 then 20 else 0 end + case when size_bytes > 0 then 15 else 0 end
  + case when author <> '' and author <> 'Unknown' then 10 else 0 end + case when license <> '' and license <> 'Unknown' then 10 else 0 end
  + case when last_updated <> '' then case when {_AGE} <= 30 then 25 when {_AGE} <= 90 then 20 when {_AGE} <= 365 then 10 else 5 end else 0 end as double)"""
_RICH = """cast(case when length(description) > 20 then 2 else 0 end + case when len(tags) > 0 then 1 else 0 end + case when size_bytes > 0 then 1 else 0 end
  + case when author <> '' and author <> 'Unknown' then 1 else 0 end + case when source = 'kaggle' then 1 else 0 end as bigint)"""
_KEY = "regexp_replace(regexp_replace(lower(trim(title)), '\\b(dataset|data|csv|kaggle|huggingface|github)\\b', '', 'g'), '[^a-z0-9]', '', 'g')"


def _keyword_score(q):
    k = f"({_keywords(chr(39) + q + chr(39))})"
    tags = "lower(array_to_string(tags, ' '))"
    points = (f"list_sum(list_transform({k}, lambda w: cast(contains(lower(title), w) as int) * 15 + cast(contains({tags}, w) as int) * 12 "
              f"+ cast(contains(lower(description), w) as int) * 5))")
    return f"case when len({k}) = 0 then 50.0 else least(100.0, (cast(contains(lower(title), lower('{q}')) as int) * 40 + {points}) / (40 + len({k}) * 32) * 100) end"


_CAT = f"cat as materialized (select * from {_DUCK} t)"
_DEDUP = f"""dd as (select * exclude (tkey, rn) from (select *, row_number() over (partition by tkey order by {_RICH} desc, arrival) as rn from (select *, {_KEY} as tkey from cat))
  where rn = 1 or tkey = '')"""
_EVERY = "title || ' ' || description || ' ' || array_to_string(tags, ' ')"


def _scored(src, semantic="0.0", q=QUERY):
    return f"""sc as (select *, {semantic} as semantic, {_keyword_score(q)} as keyword, {_META} as metadata,
  {_intent_score(_EVERY, f"({_INTENT.format(x=chr(39) + q + chr(39))})")} as intent, contains(lower(title), lower(trim('{q}'))) as hit from {src}),
rv as (select * exclude (hit), {r('least(100.0, greatest(case when hit then 35.0 when keyword > 0 then 20.0 else 12.0 end, semantic * 0.50 + keyword * 0.25 + metadata * 0.15 + intent * 0.10))', 1)} as relevance from sc),
lb as (select *, case when relevance >= 75 then 'high' when relevance >= 45 then 'medium' else 'low' end as quality from rv)"""


_OUT = f"id, title, {r('keyword', 6)} as keyword, metadata, {r('intent', 6)} as intent, relevance, quality"
_OUT_COLS = ["id", "title", "keyword", "metadata", "intent", "relevance", "quality"]
FILTERS = {"formats": ["csv"], "quality": ["low", "medium"], "size": "small", "freshness": "year", "source": ["kaggle", "huggingface"]}
_FILTERED = f"format in ('csv') and source in ('kaggle', 'huggingface') and (size_bytes = 0 or size_bytes < 10485760) and coalesce({_AGE}, 0) <= 365"


def _topk(s, d):
    emb = read(s, d, "embeddings")
    vector = emb.orderBy("vec_id").select("embedding").first()[0]
    return P.similarity_topk(emb, vector, 25, id_col="vec_id").select("vec_id", rounded(F.col("similarity"), 5).alias("similarity"))


def _batch(s, d):
    emb = read(s, d, "embeddings")
    out = P.similarity_topk_batch(emb.withColumnRenamed("vec_id", "query_id"), emb, 5, "query_id", "vec_id")
    return tidy(out.withColumn("similarity", rounded(F.col("similarity"), 5)))


def _pruned(s, d):
    """Ids as text on both sides; every vector asks."""
    emb = read(s, d, "embeddings")
    named = emb.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), "embedding")
    out = P.similarity_topk_batch(emb.select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query"), "embedding"), named, 10, "query", "name")
    return tidy(out.withColumn("similarity", rounded(F.col("similarity"), 5)))


def _batch_sql(query: str, doc: str, k: int, names: str) -> str:
    """All pairs; similarities that agree in nine digits are ties."""
    return f"""with e as (select *, cast(embedding as double[]) as v from embeddings),
      s as (select {query} as a, {doc} as b, list_cosine_similarity(a.v, b.v) as x from e a, e b),
      k as (select *, row_number() over (partition by a order by round(x, 9) desc, b) as rank from s) select a as {names.split()[0]}, b as {names.split()[1]}, {r('x', 5)} as similarity, rank from k where rank <= {k}"""


# Queries of every page: words of catalogue titles with verbs, markup, other scripts, nothing at all.
SEARCHES = """
select page_id as qid, case page_id % 7 when 0 then concat('Predict patient records from ', url) when 1 then 'weather forecast' when 2 then substr(html, 1, 60)
  when 3 then 'Compare sales by wiki source, classify them' when 4 then concat('sales forecast ', cast(page_id % 10 as {text})) when 5 then case when page_id % 2 = 0 then '' else 'ß' end
  else concat('best ', substr(html, 100, 30)) end as q from {pages}"""


def _search_batch(s, d):
    from ..plans.search_index import build_index, search_batch

    index = build_index(_catalog(s, d), AS_OF, "arrival")
    asked = derived(s, d, SEARCHES.replace("{text}", "string"))
    return tidy(search_batch(index, asked, "qid", "q", limit=10, page=2, filters={"formats": ["csv"], "size": "small"}, as_of=AS_OF).select(
        "qid", "rank", "id", "keyword", "metadata", "intent", "relevance", "quality"))


def _semantic_search(s, d):
    """Catalogue entries with TF-IDF vectors, ranked against an embedded query."""
    from ..session import local_table

    cat = _catalog(s, d).withColumn("embed_text", F.concat_ws(". ", "title", "description"))
    query = local_table(s, [{"x": 1}], "x int").select(P.embedding_text(QUERY).alias("embed_text"))
    model = P.fit_embedder(cat, "embed_text")
    vectors = P.embed(cat, "embed_text", model=model)
    qv = P.embed(query, "embed_text", model=model).first()["embedding"]
    return tidy(P.ranked_catalog(vectors, QUERY, query_vector=qv, as_of=AS_OF, arrival="arrival").select(*_OUT_COLS, "semantic"))


_V = "cast(e.embedding as double[])"
_FIRST = "(select cast(embedding as double[]) from embeddings order by vec_id limit 1)"

QUERIES = {
    "text_normalize": (lambda s, d: _texts(s, d).select("qid", Q.text_normalize(F.col("q")).alias("text")), f"select qid, {_norm('q')} as text from {_T} t"),
    "text_sanitize": (lambda s, d: _texts(s, d).select("qid", Q.text_sanitize(F.col("q")).alias("text")), f"select qid, {_sanitize('q')} as text from {_T} t"),
    "text_keywords": (lambda s, d: tidy(_texts(s, d).select("qid", Q.text_keywords(F.col("q")).alias("keywords"))),
                      f"select qid, coalesce(array_to_string({_keywords('q')}, '|'), '') as keywords from {_T} t"),
    "query_expand": (lambda s, d: _texts(s, d).select("qid", Q.query_expand(Q.text_sanitize(F.col("q")), Q.text_keywords(F.col("q"))).alias("expanded")), _EXPAND),
    "query_intent": (lambda s, d: _texts(s, d).select("qid", Q.query_intent(F.col("q")).alias("intent")), f"select qid, {_INTENT.format(x='q')} as intent from {_T} t"),
    "cosine_scores": (lambda s, d: read(s, d, "embeddings").select("vec_id", rounded(cosine(F.col("embedding"), F.array(*[F.lit((-1.0) ** i * (i + 1)) for i in range(64)])), 5).alias("similarity")),
                      f"select vec_id, {r('list_cosine_similarity(' + _V + ', cast([' + ', '.join(str((-1.0) ** i * (i + 1)) for i in range(64)) + '] as double[]))', 5)} as similarity from embeddings e"),
    "similarity_topk": (_topk, f"with s as (select vec_id, list_cosine_similarity({_V}, {_FIRST}) as x from embeddings e) select vec_id, {r('x', 5)} as similarity from s order by x desc, vec_id limit 25"),
    "similarity_topk_batch": (_batch, _batch_sql("a.vec_id", "b.vec_id", 5, "query_id vec_id")),
    "similarity_topk_pruned": (_pruned, _batch_sql("'q' || a.vec_id", "'v' || b.vec_id", 10, "query name")),
    "search_batch": (_search_batch, f"""with {_CAT}, {_DEDUP}, fl as (select * from dd where format in ('csv') and (size_bytes = 0 or size_bytes < 10485760)),
      qs as (select qid, q, {_keywords('q')} as kw, {_INTENT.format(x='q')} as wants from ({duck(SEARCHES.replace("{text}", "varchar"))}) t),
      sc as (select qid, id, title, {_META} as metadata, {_intent_score(_EVERY, 'wants')} as intent, contains(lower(title), lower(trim(q))) as hit,
        case when len(kw) = 0 then 50.0 else least(100.0, (cast(contains(lower(title), lower(q)) as int) * 40 + list_sum(list_transform(kw, lambda w: cast(contains(lower(title), w) as int) * 15
          + cast(contains(lower(array_to_string(tags, ' ')), w) as int) * 12 + cast(contains(lower(description), w) as int) * 5))) / (40 + len(kw) * 32) * 100) end as keyword from fl, qs),
      rv as (select *, {r('least(100.0, greatest(case when hit then 35.0 when keyword > 0 then 20.0 else 12.0 end, keyword * 0.25 + metadata * 0.15 + intent * 0.10))', 1)} as relevance from sc),
      rk as (select *, row_number() over (partition by qid order by relevance desc, id) as rank from rv)
      select qid, rank, id, {r('keyword', 6)} as keyword, metadata, {r('intent', 6)} as intent, relevance,
        case when relevance >= 75 then 'high' when relevance >= 45 then 'medium' else 'low' end as quality from rk where rank between 11 and 20"""),
    "keyword_score": (lambda s, d: tidy(_catalog(s, d).select("id", P.keyword_score(P.query_facts(s, QUERY)).alias("score"))),
                      f"with {_CAT} select id, {r(_keyword_score(QUERY), 6)} as score from cat"),
    "metadata_score": (lambda s, d: _catalog(s, d).select("id", P.metadata_score(AS_OF).alias("score")), f"with {_CAT} select id, {_META} as score from cat"),
    "metadata_richness": (lambda s, d: tidy(_catalog(s, d).select("id", P.metadata_richness().alias("richness"))), f"with {_CAT} select id, {_RICH} as richness from cat"),
    "intent_score": (lambda s, d: tidy(_texts(s, d).select("qid", Q.intent_score(F.col("q"), Q.query_intent(F.col("q"))).alias("score"))),
                     f"select qid, cast({_intent_score('q', '(' + _INTENT.format(x='q') + ')')} as double) as score from {_T} t"),
    "composite_rank": (lambda s, d: tidy(P.score_catalog(_catalog(s, d), QUERY, as_of=AS_OF).select(*_OUT_COLS)), f"with {_CAT}, {_scored('cat')} select {_OUT} from lb"),
    "relevance_label": (lambda s, d: read(s, d, "part").select("p_partkey", P.relevance_label(F.col("p_retailprice") / 20).alias("label")),
                        "select p_partkey, case when p_retailprice / 20 >= 75 then 'high' when p_retailprice / 20 >= 45 then 'medium' else 'low' end as label from part"),
    "catalog_dedup": (lambda s, d: P.dedup(_catalog(s, d), "arrival").select("id", "title"), f"with {_CAT}, {_DEDUP} select id, title from dd"),
    "catalog_filter": (lambda s, d: P.filter_catalog(_catalog(s, d), formats=["csv"], size="small", freshness="year", source=["kaggle", "huggingface"], as_of=AS_OF).select("id", "title"),
                       f"with {_CAT} select id, title from cat where {_FILTERED}"),
    "search": (lambda s, d: tidy(P.search(_catalog(s, d), QUERY, FILTERS, page=2, limit=10, as_of=AS_OF, arrival="arrival").rows.select(*_OUT_COLS)),
               f"with {_CAT.replace(' t)', ' t where source in (' + chr(39) + 'kaggle' + chr(39) + ', ' + chr(39) + 'huggingface' + chr(39) + '))')}, {_DEDUP}, {_scored('dd')} "
               f"select {_OUT} from lb where {_FILTERED} and quality in ('low', 'medium') order by relevance desc, id limit 10 offset 10"),
    "search_ranked": (lambda s, d: tidy(P.ranked_catalog(_catalog(s, d), QUERY, as_of=AS_OF, arrival="arrival").select(*_OUT_COLS)),
                      f"with {_CAT}, {_DEDUP}, {_scored('dd')} select {_OUT} from lb"),
    "search_semantic": (_semantic_search, None),
    "embed_text": (lambda s, d: tidy(P.embed(read(s, d, "benchmark"), "text", model=P.fit_embedder(read(s, d, "documents"), "text")).select("item_id", "embedding")), None),
    "format_number": (lambda s, d: read(s, d, "events").select("event_id", X.format_number(F.col("value") * F.col("event_id") / 7 - 3).alias("label")),
                      f"select event_id, {fmt_number('(value * event_id / 7 - 3)')} as label from events"),
    "format_bytes": (lambda s, d: read(s, d, "documents").select("doc_id", X.format_bytes(F.col("n_chars") * F.col("doc_id") * F.col("doc_id")).alias("size")),
                     f"""with x as (select doc_id, n_chars * doc_id * doc_id as b from documents) select doc_id, case when b < 1024 then b || ' B' when b < 1048576 then {fx('b / 1024', 1)} || ' KB'
                     when b < 1073741824 then {fx('b / 1048576', 1)} || ' MB' else {fx('b / 1073741824', 1)} || ' GB' end as size from x"""),
    "stable_id": (lambda s, d: read(s, d, "pages").select("page_id", X.stable_id("page", F.col("url")).alias("id")), "select page_id, 'page-' || substr(md5(url), 1, 12) as id from pages"),
    "slug_title": (lambda s, d: read(s, d, "customer").select("c_custkey", X.slug_title(F.concat(F.lit("team/my-"), F.lower("c_mktsegment"), F.lit("_set-"), F.col("c_nationkey"))).alias("title")),
                   "select c_custkey, 'My ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Set ' || c_nationkey as title from customer"),
    "truncate_label": (lambda s, d: read(s, d, "documents").select("doc_id", X.truncate_label(F.col("text"), 30).alias("label")), "select doc_id, substr(text, 1, 30) as label from documents"),
    "age_days": (lambda s, d: _catalog(s, d).select("id", X.age_days(F.col("last_updated"), F.lit(AS_OF)).alias("days")), f"with {_CAT} select id, {_AGE} as days from cat"),
}
