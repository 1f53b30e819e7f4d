"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.correlations import correlation_highlights, correlation_matrix, correlations, pair_correlations, target_correlations
from ..operators.histograms import top_values
from ..operators.quantiles import exact_quantiles
from ..operators.ranks import value_ranks
from ..operators.value_counts import most_common, value_counts
from ..session import local_table
from . import sqlprofile as S
from .base import COLUMNS, big, derived, duck, histogram_sql, numbers, r, read, relation, table, texts, tidy, top_sql, union

_CACHE: dict = {}

# A table with an empty column, empty rows, a boolean, and dates kept as text.
TYPED = """
select o_orderkey, o_totalprice > 200000 as is_large, o_totalprice, cast(o_orderdate as date) as order_day,
       o_orderstatus, cast(cast(o_orderdate as date) as {text}) as day_text, o_orderpriority, cast(null as {text}) as nothing
from {orders}"""
EMPTIES = """
select case when o_orderstatus = 'P' then null else o_orderkey end as k,
       case when o_orderstatus = 'P' then null else o_orderpriority end as p, cast(null as double) as nothing
from {orders}"""


def profile_of(spark, sf_dir, name) -> P.Profile:
    """Profiles are small and reused by many queries of one session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _CACHE:
        _CACHE[key] = P.profile(table(spark, sf_dir, name), name)
    return _CACHE[key]


def _typed(spark, d):
    return derived(spark, d, TYPED.replace("{text}", "string"))


_TYPED_DUCK = "(" + duck(TYPED.replace("{text}", "varchar")) + ")"
_EMPTIES_DUCK = "(" + duck(EMPTIES) + ")"


def _q_types(spark, d):
    return P.column_types(_typed(spark, d))


_kind = {"o_orderkey": "number", "is_large": "boolean", "o_totalprice": "number", "order_day": "date"}
_SQL_TYPES = union(
    [f"select '{c}' as name, '{t}' as type" for c, t in _kind.items()]
    + [f"select '{c}' as name, case when count({c}) > 0 and count({c}) = count(try_cast({c} as timestamp)) then 'date' else 'string' end as type "
       f"from {_TYPED_DUCK} t" for c in ("o_orderstatus", "day_text", "o_orderpriority", "nothing")])


def _q_drop_empty(spark, d):
    return P.drop_empty(derived(spark, d, EMPTIES))


def _q_shape(spark, d):
    return tidy(P.table_shape(derived(spark, d, EMPTIES)))


_SQL_SHAPE = f"""select count(*) as "rows", {big(2)} as columns from {_EMPTIES_DUCK} t where k is not null or p is not null"""


def _q_variance(spark, d):
    df = table(spark, d, "duped")
    return local_table(spark, [{"rank": i + 1, "name": c} for i, c in enumerate(P.variance_rank(df))], "rank bigint, name string")


_SQL_VARIANCE = f"""with q as ({S._variance_order('duped')})
select row_number() over (order by v desc, pos) as rank, c as name from q order by v desc, pos limit 8"""


def _tidy_dist(df):
    return tidy(df)


_SQL_ROUND_DIST = 'dataset_id, "column", kind, bin, label, ' + r("lo", 6) + " as lo, " + r("hi", 6) + ' as hi, "count"'


def _q_numeric_dist(spark, d):
    df = P.drop_empty(table(spark, d, "duped"))
    return tidy(P.numeric_distributions(df).select(F.lit("duped").alias("dataset_id"), "*"))


def _q_categorical_dist(spark, d):
    df = P.drop_empty(read(spark, d, "part"))
    return tidy(P.categorical_distributions(df, {r_["column"]: r_["unique_count"] for r_ in P.distinct_counts(df, ["p_name", "p_brand", "p_type"]).collect()})
                .select(F.lit("part").alias("dataset_id"), "*"))


COLUMNS["part"] = [("p_partkey", "number"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "number"),
                   ("p_retailprice", "number")]


def _view(part):
    return lambda spark, d: part(profile_of(spark, d, "duped"))


def _pairs(spark, d):
    return profile_of(spark, d, "duped").correlations


_R = f"with r as materialized ({S.correlations('duped')})"
_STRENGTH = ("case when abs(value) >= 0.9 then 'Very Strong' when abs(value) >= 0.7 then 'Strong' when abs(value) >= 0.5 then 'Moderate' "
             "when abs(value) >= 0.3 then 'Weak' else 'Very Weak' end")

_SQL_MATRIX = f"""{_R}, s as (select rank * 2 as place, column1 as name from r union all select rank * 2 + 1, column2 from r),
n as (select name, row_number() over (order by m) as pos from (select name, min(place) as m from s group by name)),
k as (select * from n where pos <= 12),
b as (select column1 as x, column2 as y, value from r union all select column2, column1, value from r)
select a.pos - 1 as row_pos, c.pos - 1 as col_pos, a.name as "row", c.name as col,
       case when a.name = c.name then 1.0 else coalesce(b.value, 0.0) end as value
from k a cross join k c left join b on b.x = a.name and b.y = c.name"""

_MD = f"with {S.profile_ctes(['duped'], ('m', 'c', 'd'))}"
_PCT = 'null_count * 100.0 / "rows"'

QUERIES = {
    "column_types": (_q_types, _SQL_TYPES),
    "drop_empty": (_q_drop_empty, f"select k, p from {_EMPTIES_DUCK} t where k is not null or p is not null"),
    "table_shape": (_q_shape, _SQL_SHAPE),
    "missing_pct": (lambda s, d: P.missing_pct(table(s, d, "duped")), f"select missing_pct from ({S.metrics('duped')})"),
    "duplicate_pct": (lambda s, d: P.duplicate_pct(table(s, d, "duped")), f"select duplicate_pct from ({S.metrics('duped')})"),
    "column_profile": (lambda s, d: tidy(P.column_profile(table(s, d, "duped"))),
                       f"select position, name, type, null_count, unique_count from ({S.columns('duped')})"),
    "value_counts": (lambda s, d: value_counts(table(s, d, "duped"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]),
                     union([f"select '{c}' as \"column\", cast({c} as varchar) as value, count(*) as count from {relation('duped')} t "
                            f"where {c} is not null group by 2" for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey")])),
    "column_modes": (lambda s, d: most_common(table(s, d, "duped"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]),
                     union([f"select '{c}' as \"column\", cast(min_by({c}, (-n, {c})) as varchar) as mode, max(n) as mode_count, "
                            f"cast(sum(n) as bigint) as non_null, count(*) as unique_count from (select {c}, count(*) as n from {relation('duped')} t "
                            f"where {c} is not null group by 1)" for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey")])),
    "exact_quantiles": (
        lambda s, d: tidy(local_table(s, [{"column": c, "p": p, "value": v} for c, q in exact_quantiles(
            table(s, d, "duped"), {c: [0.05, 0.25, 0.5, 0.75, 0.99] for c in numbers("duped")}).items() for p, v in q.items()],
            "column string, p double, value double")),
        union([f"select '{c}' as \"column\", cast({p} as double) as p, {r(f'quantile_cont(cast({c} as double), {p})', 6)} as value from {relation('duped')} t"
               for c in numbers("duped") for p in (0.05, 0.25, 0.5, 0.75, 0.99)])),
    "value_ranks": (lambda s, d: value_ranks(read(s, d, "lineitem"), F.col("l_extendedprice")),
                    """select value, count, row_number() over (order by value) - 1 as index,
                       cast(sum(count) over (order by value) - count as bigint) as before
                       from (select l_extendedprice as value, count(*) as count from lineitem group by 1)"""),
    "correlations_top": (lambda s, d: tidy(correlations(table(s, d, "duped"))),
                         f"select rank, column1, column2, value from ({S.correlations('duped')})"),
    "pair_correlations": (
        lambda s, d: tidy(pair_correlations(read(s, d, "lineitem")).select("column1", "column2", "pairs", "value")),
        "with a as (select " + ", ".join(f"corr({a}, {b}) as v{i}_{j}, count({a} + {b}) as n{i}_{j}" for i, a in enumerate(numbers("lineitem"))
                                         for j, b in enumerate(numbers("lineitem")) if i < j) + " from lineitem) "
        + union([f"select '{a}' as column1, '{b}' as column2, n{i}_{j} as pairs, {r(f'v{i}_{j}', 6)} as value from a"
                 for i, a in enumerate(numbers("lineitem")) for j, b in enumerate(numbers("lineitem")) if i < j])),
    "variance_rank": (_q_variance, _SQL_VARIANCE),
    "numeric_distributions": (_q_numeric_dist, f"select {_SQL_ROUND_DIST} from ({S.numeric_distributions('duped')})"),
    "categorical_distributions": (_q_categorical_dist, f"select {_SQL_ROUND_DIST} from ({S.categorical_distributions('part')})"),
    "eda": (lambda s, d: tidy(profile_of(s, d, "duped").metrics.join(
        profile_of(s, d, "duped").columns, "dataset_id")),
        f"with {S.profile_ctes(['duped'], ('m', 'c'))} select m.dataset_id, \"rows\", columns, missing_pct, duplicate_pct, position, name, type, "
        "null_count, unique_count from m join c on m.dataset_id = c.dataset_id"),
    "eda_lineitem": (lambda s, d: tidy(P.profile(read(s, d, "lineitem"), "lineitem").metrics), S.metrics("lineitem")),
    "column_completeness": (lambda s, d: tidy(P.column_completeness(profile_of(s, d, "duped"))),
                            f"{_MD} select c.dataset_id, position, name, {r(_PCT, 4)} as null_pct, {r('100.0 - ' + _PCT, 4)} as completeness_pct "
                            "from c join m on c.dataset_id = m.dataset_id"),
    "missing_map": (lambda s, d: tidy(P.missing_map(profile_of(s, d, "duped"))),
                    f"""{_MD}, x as (select c.*, {r(_PCT, 1)} as pct from c join m on c.dataset_id = m.dataset_id)
                    select dataset_id, name, type, null_count, pct, case when pct = 0 then 'none' when pct < 5 then 'minimal' when pct < 15 then 'low'
                    when pct < 30 then 'moderate' when pct < 50 then 'high' else 'severe' end as band,
                    row_number() over (order by pct desc, position) as ord from x where (select sum(null_count) from x) > 0"""),
    "target_correlations": (lambda s, d: target_correlations(_pairs(s, d), "l_quantity"),
                            f"""{_R} select case when column1 = 'l_quantity' then column2 else column1 end as feature, value, {_STRENGTH} as strength
                            from r where column1 = 'l_quantity' or column2 = 'l_quantity' order by abs(value) desc, rank limit 12"""),
    "correlation_highlights": (lambda s, d: tidy(correlation_highlights(_pairs(s, d))),
                               f"{_R} select * from r where abs(value) > 0.3 order by abs(value) desc, rank limit 3"),
    "correlation_matrix_dense": (lambda s, d: tidy(correlation_matrix(_pairs(s, d))), _SQL_MATRIX),
    "distribution_summary": (lambda s, d: tidy(P.distribution_summary(profile_of(s, d, "duped"))),
                             f"""{_MD} select dataset_id, "column", kind, cast(sum("count") as bigint) as total, count(*) as bins, max("count") as max_count,
                             arg_max(label, ("count", -bin)) as modal_label, {r('max("count") * 100.0 / sum("count")', 1)} as modal_share_pct
                             from d group by 1, 2, 3"""),
    "distribution_shares": (lambda s, d: tidy(P.distribution_shares(profile_of(s, d, "duped"))),
                            f"""{_MD} select dataset_id, "column", bin, label, "count",
                            {r('"count" * 100.0 / sum("count") over (partition by dataset_id, "column")', 1)} as share_pct from d"""),
}
