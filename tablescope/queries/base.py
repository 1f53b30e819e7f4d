"""Input tables of the registered queries and small SQL text helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import quoted, rounded

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]

# Derived inputs, written so that both engines read the same text. Gaps, a constant,
# a near-copy and repeated rows are injected: the plain tables have none.
DIRTY = """
select l_orderkey, l_linenumber, l_quantity, l_extendedprice,
       case when l_orderkey % 50 = 0 then null else l_tax end as l_tax,
       case when l_orderkey % 11 = 0 then null else l_discount end as l_discount,
       case when l_partkey % 5 < 3 then null else l_suppkey end as l_suppkey,
       case when l_linenumber % 7 = 3 then null else l_returnflag end as l_returnflag,
       l_linestatus, cast(1.0 as double) as const_col, l_quantity * 2.0 + l_tax as qty_twin
from {lineitem}"""
DUPED = f"select * from ({DIRTY}) union all select * from ({DIRTY}) where l_linenumber = 7"
SUPPLIER_GAPS = """
select s_suppkey, s_name, case when s_suppkey % 7 = 3 then null else s_nationkey end as s_nationkey,
       case when s_suppkey % 5 = 2 then null else s_acctbal end as s_acctbal
from {supplier}"""
CUSTOMER_GAPS = """
select c_custkey, c_name, case when c_custkey % 9 = 4 then null else c_nationkey end as c_nationkey,
       case when c_custkey % 10 = 6 then null else c_acctbal end as c_acctbal,
       case when c_custkey % 8 = 1 then null else c_mktsegment end as c_mktsegment
from {customer}"""
LABELED = """
select a.doc_id, a.quality, a.toxic, d.n_chars, length(d.text) as text_length, d.lang
from {labels} a join {documents} d on a.doc_id = d.doc_id"""

# Column layouts for the generated SQL: (name, logical type).
COLUMNS = {
    "duped": [("l_orderkey", "number"), ("l_linenumber", "number"), ("l_quantity", "number"), ("l_extendedprice", "number"),
              ("l_tax", "number"), ("l_discount", "number"), ("l_suppkey", "number"), ("l_returnflag", "string"),
              ("l_linestatus", "string"), ("const_col", "number"), ("qty_twin", "number")],
    "orders": [("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "string"), ("o_totalprice", "number"),
               ("o_orderdate", "date"), ("o_orderpriority", "string")],
    "customer": [("c_custkey", "number"), ("c_name", "string"), ("c_nationkey", "number"), ("c_acctbal", "number"), ("c_mktsegment", "string")],
    "documents": [("doc_id", "number"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "number")],
    "labels": [("doc_id", "number"), ("quality", "number"), ("toxic", "number")],
    "events": [("event_id", "number"), ("ts", "date"), ("user_id", "number"), ("event_type", "string"), ("value", "number"), ("props", "string")],
    "lineitem": [("l_orderkey", "number"), ("l_partkey", "number"), ("l_suppkey", "number"), ("l_linenumber", "number"),
                 ("l_quantity", "number"), ("l_extendedprice", "number"), ("l_discount", "number"), ("l_tax", "number"),
                 ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "date")],
    "dirty": None,
}
COLUMNS["dirty"] = COLUMNS["duped"]
JUDGED = ["duped", "orders", "documents", "labels"]       # the tables of the judgement queries


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "duped":
        return derived(spark, sf_dir, DUPED)
    if name == "dirty":
        return derived(spark, sf_dir, DIRTY)
    return read(spark, sf_dir, name)


def duck(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def relation(name: str) -> str:
    """The same input as a DuckDB relation."""
    return {"duped": f"({duck(DUPED)})", "dirty": f"({duck(DIRTY)})"}.get(name, name)


def numbers(name: str) -> list[str]:
    return [c for c, t in COLUMNS[name] if t == "number"]


def texts(name: str) -> list[str]:
    return [c for c, t in COLUMNS[name] if t == "string"]


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable values: doubles rounded, integers as bigint, arrays as text."""
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = rounded(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        out.append(c.alias(f.name))
    return df.select(out)


# ---- DuckDB text ------------------------------------------------------------------

def r(x: str, digits: int) -> str:
    return f"cast(round(cast({x} as decimal(38,10)), {digits}) as double)"


def fx(x: str, digits: int) -> str:
    return f"cast(cast(round(cast({x} as decimal(38,10)), {digits}) as decimal(38,{digits})) as varchar)"


def big(x: str) -> str:
    return f"cast({x} as bigint)"


def fmt_number(x: str) -> str:
    return (f"case when abs({x}) >= 1000000 then {fx(f'({x})/1000000', 1)} || 'M' when abs({x}) >= 1000 then {fx(f'({x})/1000', 1)} || 'K' "
            f"when abs({x}) >= 1 then {fx(x, 1)} when abs({x}) >= 0.01 then {fx(x, 2)} else {fx(x, 3)} end")


def skew(x: str) -> str:
    return f"case when count({x}) >= 3 then case when min({x}) = max({x}) then 0.0 else skewness({x}) end end"


def kurt(x: str) -> str:
    return f"case when count({x}) >= 4 then case when min({x}) = max({x}) then 0.0 else kurtosis({x}) end end"


def union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


def histogram_sql(rel: str, col: str, bins: str) -> str:
    """CTEs v, p, g(bin, lo, hi, count, n, w): ``bins`` is an expression over n."""
    return f"""
v as (select cast({col} as double) as x from {rel} where {col} is not null),
p0 as (select count(*) as n, min(x) as mn, max(x) as mx from v),
p1 as (select n, cast({bins} as int) as nb, case when mn = mx then mn - 0.5 else mn end as lo, case when mn = mx then mx + 0.5 else mx end as hi from p0),
p as (select *, (hi - lo) / nb as w from p1),
i0 as (select x, lo, w, nb, greatest(0, least(cast(floor((x - lo) / (hi - lo) * nb) as int), nb - 1)) as b from v, p),
i as (select case when x < b * w + lo then b - 1 when b < nb - 1 and x >= (b + 1) * w + lo then b + 1 else b end as bin from i0),
c as (select bin, count(*) as cnt from i group by bin),
k as (select cast(unnest(range(nb)) as int) as bin, lo, hi, w, nb, n from p),
g as (select k.bin, k.bin * k.w + k.lo as lo, case when k.bin = k.nb - 1 then k.hi else (k.bin + 1) * k.w + k.lo end as hi,
             coalesce(c.cnt, 0) as cnt, k.n, k.w from k left join c on k.bin = c.bin)"""


def top_sql(rel: str, col: str, keep: int) -> str:
    """CTEs t(value, cnt, rn) and shown(bin, value, cnt) with the 'Other' row."""
    return f"""
t as (select cast({col} as varchar) as value, count(*) as cnt, row_number() over (order by count(*) desc, cast({col} as varchar)) as rn
      from {rel} where {col} is not null group by 1),
shown as (select rn - 1 as bin, value, cnt from t where rn <= {keep}
          union all select {keep}, 'Other', cast(sum(cnt) as bigint) from t where rn > {keep} having count(*) > 0)"""
