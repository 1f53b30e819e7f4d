"""Source, sink and catalogue-record queries. Files are written from the given
tables into the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import json_safe
from ..operators.profile import preview, row_cap
from ..plans.analyze import analyze
from ..session import scratch_path
from ..sources import catalog as G
from ..sources.csv_source import read_csv
from ..sources.files import discover_files
from ..sources.growing import profile_growing, update
from ..sources.store import load_analysis, load_profile, profile_once, save_analysis, save_profile, write
from . import judge as J
from . import sqlprofile as S
from .base import JUDGED, derived, r, read, table, tidy
from .profiling import profile_of

# ---- CSV ---------------------------------------------------------------------------


def _csv(s, d):
    """Customers as semicolon-separated latin-1 text with an overlong line per nation."""
    rows = read(s, d, "customer").select(F.concat_ws(";", "c_custkey", F.concat(F.lit("Zoë "), "c_name"), "c_nationkey", "c_acctbal", "c_mktsegment").alias("line"))
    extra = read(s, d, "nation").select(F.concat_ws(";", "n_nationkey", "n_name", F.lit("1"), F.lit("2"), F.lit("x"), F.lit("too"), F.lit("long")).alias("line"))
    path = scratch_path(s, "csv")
    # The header option writes the column name as the first line of every file.
    header = "c_custkey;c_name;c_nationkey;c_acctbal;c_mktsegment"
    rows.unionByName(extra).withColumnRenamed("line", header).coalesce(1).write.option("header", True).option("encoding", "ISO-8859-1").option("quote", "\u0000").option(
        "sep", "\u0001").csv(path)
    return read_csv(s, path)[0]


def _csv_plain(s, d):
    path = scratch_path(s, "csv")
    write(derived(s, d, "select o_orderkey, o_orderstatus, o_totalprice, o_totalprice > 300000 as is_large, o_orderpriority, cast(null as string) as note from {orders}"), path, "csv")
    return tidy(read_csv(s, path)[0])


def _lines(rows, header, path, encoding="UTF-8", mode="error"):
    """Lines as they are, in several files, each with ``header`` as its first line."""
    rows.withColumnRenamed("line", header).repartition(3).write.mode(mode).option("header", True).option("encoding", encoding).option("quote", "\u0000").option(
        "sep", "\u0001").csv(path)


def _csv_multiline(s, d):
    """A quoted line break, quotes and a comma in every order's note."""
    path = scratch_path(s, "csv")
    note = F.concat("o_orderstatus", F.lit('\n"'), "o_orderpriority", F.lit('", x'))
    orders = read(s, d, "orders").select("o_orderkey", note.alias("note"), "o_custkey")
    orders.repartition(3, "o_orderkey").write.option("header", True).option("escape", '"').csv(path)
    return read_csv(s, path)[0]


def _csv_mixed(s, d):
    """UTF-8 with commas and latin-1 with semicolons, in another order of columns, in one folder."""
    path, customers = scratch_path(s, "csv"), read(s, d, "customer").withColumn("name", F.concat(F.lit("Zoë "), "c_name"))
    low = F.col("c_nationkey") < 10
    _lines(customers.where(low).select(F.concat_ws(",", "c_custkey", "name", "c_nationkey").alias("line")), "c_custkey,name,c_nationkey", path)
    _lines(customers.where(~low).select(F.concat_ws(";", "c_nationkey", "c_custkey", "name", "c_mktsegment").alias("line")),
           "c_nationkey;c_custkey;name;c_mktsegment", path, "ISO-8859-1", "append")
    return read_csv(s, path)[0].select("c_custkey", "name", "c_nationkey", "c_mktsegment")


def _csv_overlong(s, d):
    """Every seventh customer has one field too many, empty for some and followed by another for others."""
    path = scratch_path(s, "csv")
    more = F.expr("case when c_custkey % 7 <> 0 then '' when c_custkey % 2 = 0 then ',' else ',,LOST' end")
    _lines(read(s, d, "customer").select(F.concat(F.concat_ws(",", "c_custkey", "c_name", "c_nationkey"), more).alias("line")), "c_custkey,c_name,c_nationkey", path)
    return read_csv(s, path)[0]


def _write(s, d, fmt):
    path = write(read(s, d, "part"), scratch_path(s, fmt), fmt)
    return s.read.format(fmt).load(path)


FILE_ROWS = 1_000_000       # of the larger table of a folder in one file


def _files(s, d):
    """Tables as files; those of one folder have as many files each, so that the largest file belongs to the largest table."""
    root = scratch_path(s, "files")
    for folder, tables in (("shop", ("customer", "orders")), ("goods", ("part",))):
        frames = {t: read(s, d, t) for t in tables}
        files = max(1, *[-(-x.count() // FILE_ROWS) for x in frames.values()])
        for t, x in frames.items():
            write(x.repartition(files) if files > 1 else x.coalesce(1), f"{root}/{folder}/{t}", "csv")
    page = F.concat(F.lit("<html>"), F.regexp_replace("html", "[\\r\\n\\t,\"]", " "))        # nothing the writer would quote
    read(s, d, "pages").select(F.trim(page).alias("html")).write.csv(f"{root}/goods/pages")
    return discover_files(s, root).select("dataset", F.regexp_extract("path", "/([^/]+)/[^/]+$", 1).alias("table_name"))


def _store(s, d):
    root = scratch_path(s, "store")
    for name in ("duped", "labels"):
        save_profile(profile_of(s, d, name), root)
    save_profile(profile_of(s, d, "labels"), root)                  # a repeat replaces its own partition only
    p = load_profile(s, root, "duped")
    return tidy(p.metrics.join(p.columns, "dataset_id"))


def _store_once(s, d):
    root = scratch_path(s, "store")
    profile_once(read(s, d, "labels"), "labels", root)
    return tidy(profile_once(read(s, d, "labels"), "labels", root).columns)


def _growing(s, d):
    """The table in two parts; the first has its states before the second arrives."""
    data, root, whole = scratch_path(s, "grown"), scratch_path(s, "states"), table(s, d, "duped")
    early = F.col("l_orderkey") % 3 == 0
    whole.where(early).write.parquet(data)
    update(s, data, root)
    whole.where(~early).write.mode("append").parquet(data)
    return profile_growing(s, data, root, "duped")


def _growing_profile(s, d):
    g = _growing(s, d)
    return tidy(g.metrics.join(g.columns, "dataset_id"))


def _analysis_stored(s, d):
    """Whole analyses, one of them stored twice: only its last version counts."""
    root = scratch_path(s, "analyses")
    whole = analyze({name: table(s, d, name) for name in JUDGED})
    save_analysis(whole, root)
    save_analysis(analyze({"labels": table(s, d, "labels")}), root)
    back = load_analysis(s, root)
    return back.score.select("dataset_id", "score", "quality")


# ---- catalogue records: one raw JSON record per document, page or conversation turn -------


def _raw_kaggle(s, d):
    x = derived(s, d, """select concat(source, '/', lang, '-set-', cast(doc_id as string)) as ref, concat('Set ', cast(doc_id as string)) as title,
      case when doc_id % 3 = 0 then '' else concat('Texts in ', lang) end as subtitle, text as description, n_chars * doc_id * 100 as totalBytes,
      case when doc_id % 4 = 0 then null else '2024-01-02T03:04:05Z' end as lastUpdated, array(lang, source) as tags,
      case when doc_id % 5 = 0 then null else 'CC0' end as licenseName from {documents}""")
    return x.select(F.to_json(F.struct("*")).alias("record"))


_SQL_KAGGLE = f"""with x as (select concat(source, '/', lang, '-set-', doc_id) as ref, n_chars * doc_id * 100 as b, * from documents)
select 'kaggle-' || substr(md5(ref), 1, 12) as id, concat('Set ', doc_id) as title, case when doc_id % 3 = 0 then text else concat('Texts in ', lang) end as description,
  'kaggle' as source, 'csv' as format, case when b < 1024 then b || ' B' when b < 1048576 then cast(cast(round(cast(b / 1024 as decimal(38,10)), 1) as decimal(38,1)) as varchar) || ' KB'
  when b < 1073741824 then cast(cast(round(cast(b / 1048576 as decimal(38,10)), 1) as decimal(38,1)) as varchar) || ' MB'
  else cast(cast(round(cast(b / 1073741824 as decimal(38,10)), 1) as decimal(38,1)) as varchar) || ' GB' end as size, b as size_bytes, ref as download_url,
  lang || '|' || source as tags, case when doc_id % 4 = 0 then '' else '2024-01-02T03:04:05Z' end as last_updated, source as author,
  case when doc_id % 5 = 0 then 'Unknown' else 'CC0' end as license from x"""


def _raw_hf(s, d):
    x = derived(s, d, """select case when doc_id % 7 = 0 then concat('plain-', cast(doc_id as string)) else concat(source, '/my_', lang, '-texts') end as id,
      case when doc_id % 2 = 0 then text end as description, named_struct('description', concat('Card ', text), 'license', case when doc_id % 3 = 0 then null else 'mit' end) as cardData,
      array(lang, source, 'a', 'b', 'c', 'd', 'e', 'f', 'g', 'h', 'i', 'j') as tags, '2024-02-03T00:00:00.000Z' as lastModified, n_chars * 1000 as downloads from {documents}""")
    return x.select(F.to_json(F.struct("*")).alias("record"))


_SQL_HF = """with x as (select case when doc_id % 7 = 0 then concat('plain-', doc_id) else concat(source, '/my_', lang, '-texts') end as ref, * from documents)
select 'hf-' || substr(md5(ref), 1, 12) as id, case when doc_id % 7 = 0 then ref else 'My ' || upper(lang[1]) || lang[2:] || ' Texts' end as title,
  case when doc_id % 2 = 0 and text <> '' then text else concat('Card ', text) end as description, 'huggingface' as source, 'csv' as format,
  format('{:,}', n_chars * 1000) || ' downloads' as size, cast(0 as bigint) as size_bytes, 'https://huggingface.co/datasets/' || ref as download_url,
  lang || '|' || source || '|a|b|c|d|e|f|g|h|i|j' as tags, '2024-02-03T00:00:00.000Z' as last_updated, case when doc_id % 7 = 0 then 'HuggingFace' else source end as author,
  case when doc_id % 3 = 0 then 'Unknown' else 'mit' end as license from x"""


def _raw_github(s, d):
    x = derived(s, d, """select concat(source, '/', lang, '_repo-', cast(doc_id as string)) as full_name, concat(lang, '_repo-', cast(doc_id as string)) as name,
      case when doc_id % 2 = 0 then null else text end as description, n_chars * 100 as size, case when doc_id % 3 = 0 then null else array(lang) end as topics,
      '2023-05-06T07:08:09Z' as updated_at, case when doc_id % 5 = 0 then null else named_struct('login', source) end as owner,
      case when doc_id % 4 = 0 then null else named_struct('spdx_id', 'MIT') end as license, doc_id as stargazers_count,
      concat('https://example.org/', cast(doc_id as string)) as html_url from {documents}""")
    return x.select(F.to_json(F.struct("*")).alias("record"))


_SQL_GITHUB = """with x as (select n_chars * 102400 as b, * from documents)
select 'gh-' || substr(md5(concat(source, '/', lang, '_repo-', doc_id)), 1, 12) as id, upper(lang[1]) || lang[2:] || ' Repo ' || doc_id as title,
  case when doc_id % 2 = 0 then '' else text end as description, 'github' as source, 'csv' as format,
  case when b < 1048576 then cast(cast(round(cast(b / 1024 as decimal(38,10)), 1) as decimal(38,1)) as varchar) || ' KB'
  when b < 1073741824 then cast(cast(round(cast(b / 1048576 as decimal(38,10)), 1) as decimal(38,1)) as varchar) || ' MB'
  else cast(cast(round(cast(b / 1073741824 as decimal(38,10)), 1) as decimal(38,1)) as varchar) || ' GB' end as size, b as size_bytes,
  'https://example.org/' || doc_id as download_url, case when doc_id % 3 = 0 then '' else lang end as tags, '2023-05-06T07:08:09Z' as last_updated,
  case when doc_id % 5 = 0 then 'Unknown' else source end as author, case when doc_id % 4 = 0 then 'Unknown' else 'MIT' end as license from x"""


def _union(s, d):
    a, b, c = G.normalize_kaggle(_raw_kaggle(s, d)), G.normalize_huggingface(_raw_hf(s, d)), G.normalize_github(_raw_github(s, d))
    return tidy(G.union_catalogs(a, b, c))


_EV = f"select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when microsecond(ts) % 1000000 = 0 then '' else '.' || lpad(cast(microsecond(ts) % 1000000 as varchar), 6, '0') end as ts, user_id, event_type, {r('value', 4)} as value, props from events"

QUERIES = {
    "analysis_stored": (_analysis_stored, J.QUERIES["quality_overall"][1]),
    "read_csv_resilient": (_csv, "select c_custkey, 'Zoë ' || c_name as c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from customer"),
    "read_csv_plain": (_csv_plain, f"select o_orderkey, o_orderstatus, {r('o_totalprice', 6)} as o_totalprice, o_totalprice > 300000 as is_large, o_orderpriority, cast(null as varchar) as note from orders"),
    "read_csv_multiline": (_csv_multiline, "select o_orderkey, concat(o_orderstatus, chr(10), '\"', o_orderpriority, '\", x') as note, cast(o_custkey as bigint) as o_custkey from orders"),
    "read_csv_mixed_folder": (_csv_mixed, "select c_custkey, 'Zoë ' || c_name as name, cast(c_nationkey as bigint) as c_nationkey, case when c_nationkey >= 10 then c_mktsegment end as c_mktsegment from customer"),
    "read_csv_overlong": (_csv_overlong, "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey from customer where c_custkey % 7 <> 0"),
    "row_cap": (lambda s, d: tidy(row_cap(read(s, d, "orders").select("o_orderkey", "o_totalprice"), 500, ["o_totalprice", "o_orderkey"])[0]),
                f"select o_orderkey, {r('o_totalprice', 6)} as o_totalprice from orders order by o_totalprice, o_orderkey limit 500"),
    "discover_main_file": (_files, """select 'goods' as dataset, 'part' as table_name union all
      select 'shop', case when (select sum(length(o_orderpriority) + 30) from orders) > (select sum(length(c_name) + 20) from customer) then 'orders' else 'customer' end"""),
    "sample_preview": (lambda s, d: tidy(preview(read(s, d, "events"), 20, "event_id")), _EV + " order by event_id limit 20"),
    "json_safe": (lambda s, d: tidy(json_safe(read(s, d, "events"))), _EV),
    "catalog_from_kaggle": (lambda s, d: tidy(G.normalize_kaggle(_raw_kaggle(s, d))), _SQL_KAGGLE),
    "catalog_from_huggingface": (lambda s, d: tidy(G.normalize_huggingface(_raw_hf(s, d))), _SQL_HF),
    "catalog_from_github": (lambda s, d: tidy(G.normalize_github(_raw_github(s, d))), _SQL_GITHUB),
    "catalog_union": (_union, f"select * from ({_SQL_KAGGLE}) union all by name select * from ({_SQL_HF}) union all by name select * from ({_SQL_GITHUB})"),
    "write_table": (lambda s, d: tidy(_write(s, d, "parquet")),
                    f"select p_partkey, p_name, p_brand, p_type, cast(p_size as bigint) as p_size, {r('p_retailprice', 6)} as p_retailprice from part"),
    "analysis_store": (_store, f"with {S.profile_ctes(['duped'], ('m', 'c'))} select m.dataset_id, \"rows\", columns, missing_pct, duplicate_pct, position, name, type, null_count, "
                               "unique_count from m join c on m.dataset_id = c.dataset_id"),
    "profile_growing": (_growing_profile, f"with {S.profile_ctes(['duped'], ('m', 'c'))} select m.dataset_id, \"rows\", columns, missing_pct, duplicate_pct, position, name, type, null_count, "
                                          "unique_count from m join c on m.dataset_id = c.dataset_id"),
    "profile_growing_correlations": (lambda s, d: tidy(_growing(s, d).correlations), S.correlations("duped")),
    "analysis_store_cached": (_store_once, S.columns("labels")),
}
