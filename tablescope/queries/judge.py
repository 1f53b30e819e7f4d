"""Score, insights, bias, recommendation, next steps and comparison queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators.profile import Profile
from ..plans import bias as B
from ..plans.compare import compare, compare_winner, dataset_summary
from ..plans.insights import insights
from ..plans.next_steps import next_steps
from ..plans.recommend import class_models, column_roles, detect_domain, detect_target, pick_time_target, recommend, use_cases
from ..plans.rules import DOMAIN_PARTS, MODELS, SENSITIVE_PARTS, TARGET_PARTS, USE_CASES
from ..plans.score import overall_score, quality_label, quality_score
from ..session import local_table
from . import sqlprofile as S
from .base import COLUMNS, JUDGED, LABELED, big, derived, duck, fx, numbers, r, relation, skew, table, texts, tidy, union
from .profiling import profile_of

_CACHE: dict = {}


def profiles(spark, d) -> Profile:
    return reduce(Profile.union, [profile_of(spark, d, n) for n in JUDGED])


def _cached(spark, d, what, make):
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _CACHE:
        _CACHE[key] = make()
    return _CACHE[key]


def roles(spark, d, p: Profile | None = None):
    """Column roles; distinct counts that the profiles ``p`` already hold are not taken again."""
    def make():
        known = {n: None for n in JUDGED}
        if p is not None:
            known = {n: {} for n in JUDGED}
            for r in p.columns.select("dataset_id", "name", "unique_count").collect():      # one row per column
                known[r["dataset_id"]][r["name"]] = r["unique_count"]
        return reduce(lambda a, b: a.unionByName(b), [column_roles(table(spark, d, n), n, known[n]) for n in JUDGED])

    return _cached(spark, d, "roles", make)


def warnings(spark, d):
    def make():
        targets = {x["dataset_id"]: x["target"] for x in recommend(roles(spark, d)).collect()}
        return reduce(lambda a, b: a.unionByName(b), [B.bias_warnings(table(spark, d, n), n, targets[n]) for n in JUDGED])

    return _cached(spark, d, "warnings", make)


def _ladder(x, steps):
    whens = " ".join(f"when {x} <= {b} then {v}" for b, v in steps[:-1])
    return f"case {whens} else {steps[-1][1]} end"


# ---- score --------------------------------------------------------------------------
_FACTS = """f as (select m.*, coalesce(kinds, 0) as kinds, coalesce(numbers, 0) as numbers, coalesce(strings, 0) as strings from m left join
 (select dataset_id, count(distinct type) as kinds, count(case when type = 'number' then 1 end) as numbers,
         count(case when type = 'string' then 1 end) as strings from c group by 1) k on m.dataset_id = k.dataset_id)"""
_Q4 = "'{}'"
_SCORE = f"""s as (
select dataset_id, 'completeness' as name, {_ladder('missing_pct', [(1, '30.0'), (5, '25.0'), (15, '18.0'), (30, '10.0'), (None, '3.0')])} as score, 30.0 as max_score,
  {_ladder('missing_pct', [(1, "'Excellent'"), (5, "'Good'"), (15, "'Fair'"), (None, "'Poor'")])} as label from f
union all select dataset_id, 'uniqueness', {_ladder('duplicate_pct', [(0.5, '20.0'), (2, '16.0'), (5, '10.0'), (15, '5.0'), (None, '1.0')])}, 20.0,
  {_ladder('duplicate_pct', [(0.5, "'Excellent'"), (2, "'Good'"), (5, "'Fair'"), (None, "'Poor'")])} from f
union all select dataset_id, 'size', case when "rows" >= 1000 and columns >= 3 then 25.0 when "rows" >= 500 and columns >= 2 then 20.0
  when "rows" >= 100 then 15.0 when "rows" >= 50 then 10.0 else 5.0 end, 25.0,
  case when "rows" < 100 then 'Poor' when "rows" >= 10000 then 'Excellent' when "rows" >= 1000 then 'Good' else 'Fair' end from f
union all select dataset_id, 'diversity', case when kinds = 0 then 12.0 when kinds >= 3 and numbers > 0 and strings > 0 then 25.0 when kinds >= 2 then 20.0
  when numbers > 0 or strings > 0 then 15.0 else 10.0 end, 25.0,
  case when kinds = 0 then 'Unknown' when kinds >= 3 and numbers > 0 and strings > 0 then 'Excellent' when kinds >= 2 then 'Good'
  when numbers > 0 or strings > 0 then 'Fair' else 'Poor' end from f),
o as (select dataset_id, {r('sum(score)', 1)} as score from s group by 1)"""
_MC = f"with {S.profile_ctes(JUDGED, ('m', 'c'))}, {_FACTS}, {_SCORE}"
_LABEL = "case when score >= 70 then 'high' when score >= 40 then 'medium' else 'low' end"

# ---- insights -----------------------------------------------------------------------
_ALL = f"with {S.profile_ctes(JUDGED)}"
_INS = f"""
ns as (select c.*, {r('null_count * 100.0 / "rows"', 1)} as pct, "rows" from c join m on c.dataset_id = m.dataset_id where null_count > 0),
kd as (select *, case when unique_count = 1 then 'constant_columns' when unique_count = 2 and type <> 'boolean' then 'binary_columns'
  when type = 'number' and unique_count <= 5 then 'low_card_numeric' end as kind from c),
ct as (select *, case when abs(value) >= 0.9 then 0 when abs(value) >= 0.7 then 1 when abs(value) >= 0.5 then 2 end as tier from r),
un as (select dataset_id, "column" from d group by 1, 2 having count(*) >= 2 and max("count") > 0 and min("count") / max("count") < 0.1),
ins as (
select dataset_id, 1 as ord, 'missing_tier' as rule, case when missing_pct <= 2 then 'info' when missing_pct <= 10 then 'warning' else 'critical' end as severity,
  'missing' as category, '' as evidence from m
union all select dataset_id, 100 + position, 'missing_column', 'warning', 'missing', name from ns where pct > 10 and pct <= 30
union all select dataset_id, 100000, 'missing_columns_critical', 'critical', 'missing', string_agg(name, '|' order by position) from ns where pct > 30 group by 1
union all select dataset_id, 200000, 'duplicate_tier', case when duplicate_pct <= 1 then 'info' when duplicate_pct <= 5 then 'warning' else 'critical' end,
  'duplicates', '' from m
union all select dataset_id, 300000, 'size_tier', case when "rows" < 100 then 'warning' else 'info' end, 'size', '' from m
union all select dataset_id, case kind when 'constant_columns' then 400000 when 'binary_columns' then 400001 else 400002 end, kind,
  case kind when 'constant_columns' then 'critical' else 'info' end, 'column', string_agg(name, '|' order by position) from kd where kind is not null group by 1, 2, 3, 4
union all select c.dataset_id, 400003, 'id_like_columns', 'warning', 'column', string_agg(name, '|' order by position) from c join m on c.dataset_id = m.dataset_id
  where type = 'string' and unique_count / "rows" > 0.9 group by 1
union all select dataset_id, 500000 + tier, ['corr_very_strong', 'corr_strong', 'corr_moderate'][tier + 1], ['critical', 'warning', 'info'][tier + 1], 'correlation',
  string_agg(column1 || ' / ' || column2, '|' order by rank) from ct where tier is not null group by dataset_id, tier
union all select dataset_id, 600000, 'skewed_distributions', 'warning', 'distribution', string_agg("column", '|' order by "column") from un group by 1
union all select dataset_id, 700000, 'feature_diversity', case when count(case when type = 'number' then 1 end) > 0 then 'info' else 'warning' end, 'column', ''
  from c group by 1 having count(case when type = 'string' then 1 end) > 0)"""

# ---- bias ---------------------------------------------------------------------------


def _figures(name: str) -> str:
    """Per numeric column: n, skew, outlier share, share of the commonest value, range with null as 0."""
    rel = relation(name)
    parts = []
    for i, c in enumerate(numbers(name)):
        pos = [x for x, _ in COLUMNS[name]].index(c)
        parts.append(f"""select '{name}' as dataset_id, '{c}' as "column", {big(pos)} as position, n as non_null, case when n >= 20 then sk end as skew,
  case when n >= 20 and q3 <> q1 then (select count(*) from {rel} t where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) * 100.0 / n end as outlier_pct,
  case when n >= 10 then (select max(k) from (select count(*) as k from {rel} t where {c} is not null group by {c})) * 100.0 / n end as top_pct, lo, hi
  from (select count({c}) as n, {skew(c)} as sk, quantile_cont(cast({c} as double), 0.25) as q1, quantile_cont(cast({c} as double), 0.75) as q3,
        min(coalesce({c}, 0)) as lo, max(coalesce({c}, 0)) as hi from {rel} t)""")
    return union(parts)


def _warn(kind, severity, ord_, names, where, group="group by dataset_id"):
    return (f"select dataset_id, {big(ord_)} as ord, '{kind}' as type, {severity} as severity, {names} as affected_columns from fg where {where} {group}")


_NAMES = "string_agg(\"column\", '|' order by position)"
_SKEW = union([_warn("feature_skewness", "'high'", 1, _NAMES, "abs(skew) > 3"),
               _warn("feature_skewness", "'medium'", 2, _NAMES, "abs(skew) > 2 and abs(skew) <= 3")])
_DOM = """select dataset_id, cast(3 as bigint) as ord, 'feature_dominance' as type, 'medium' as severity,
  string_agg(case when lo <> hi then "column" end, '|' order by position) as affected_columns from fg group by dataset_id
  having count(*) >= 3 and count(case when lo <> hi then 1 end) between 1 and 3 and count(*) > 3 * count(case when lo <> hi then 1 end)"""
_OUT = _warn("outlier_heavy", "case when count(*) <= 3 then 'medium' else 'high' end", 4, _NAMES, "outlier_pct > 10")
_LOW = _warn("low_variance", "'medium'", 5, _NAMES, "top_pct > 95")


def _proxy_sql(names: list[str]) -> str:
    cols = union([f"select '{n}' as dataset_id, '{c}' as name, {i} as position" for n in names for i, (c, _) in enumerate(COLUMNS[n])])
    hit = " or ".join(f"contains(replace(replace(lower(name), '_', ''), '-', ''), '{p}')" for p in SENSITIVE_PARTS)
    return (f"select dataset_id, cast(6 as bigint) as ord, 'proxy_variable' as type, 'medium' as severity, string_agg(name, '|' order by position) as affected_columns "
            f"from ({cols}) where {hit} group by 1")


def _imbalance_sql(name: str, target: str, rel: str | None = None) -> str:
    rel = rel or relation(name)
    return f"""select '{name}' as dataset_id, cast(0 as bigint) as ord, 'class_imbalance' as type, case when top >= 80 then 'high' else 'medium' end as severity,
  '{target}' as affected_columns from (select count(*) as classes, max(k) * 100.0 / sum(k) as top
  from (select count(*) as k from {rel} t where {target} is not null group by {target})) where classes >= 2 and top >= 70"""


# Tables with few varying columns, many copies of a value, and tails.
FLATS = """
select o_orderkey as k, cast(1 as int) as one, cast(2 as double) as two, cast(3 as double) as three,
       case when o_orderkey = 1 then 1.0 else 0.0 end as rare, case when o_totalprice > 495000 then o_totalprice * 50 else 10.0 end as tail
from {orders}"""
# Two columns vary among eight, so they dominate as a whole table.
DOMINATED = """
select o_orderkey as k, cast(1 as int) as one, cast(2 as double) as two, cast(3 as double) as three, o_totalprice as price, cast(4 as double) as four,
       cast(5 as bigint) as five, case when o_orderkey < 0 then 1.0 else 0.0 end as never
from {orders}"""
PEOPLE = """
select c_custkey as customer_id, c_name as name, c_nationkey as nationality_code, c_mktsegment as "Marital-Status", c_acctbal as zip_code,
       c_acctbal as average_balance from {customer}"""
HEAVY = """
select o_orderkey as k, case when o_orderpriority = '1-URGENT' then o_totalprice * 40 else o_orderkey * 1.0 end as a,
       case when o_orderstatus = 'P' then o_totalprice * 10 else 5.0 + o_custkey * 0.001 end as b from {orders}"""
for _name, _cols in (("flats", "k one two three rare tail"), ("heavy", "k a b"), ("dominated", "k one two three price four five never")):
    COLUMNS[_name] = [(c, "number") for c in _cols.split()]


def _figures_of(name: str, sql: str) -> str:
    return f"with base as materialized ({duck(sql)}), fg as ({_figures(name).replace(f'from {name} t', 'from base t')})"


def _pick(df):
    return tidy(df.select("dataset_id", "ord", "type", "severity", "affected_columns"))


def _flats(spark, d):
    return derived(spark, d, FLATS)


# ---- recommendation -----------------------------------------------------------------


def _roles_sql(names: list[str]) -> str:
    parts = []
    for n in names:
        rel = relation(n)
        for i, (c, t) in enumerate(COLUMNS[n]):
            base = f"select '{n}' as dataset_id, {big(i)} as position, '{c}' as name"
            total = f"(select count(*) from {rel} t)"
            if t == "number":
                parts.append(f"{base}, 'numeric' as role, count(distinct {c}) as unique_count, cast(null as double) as avg_length, count(*) as \"rows\" from {rel} t")
            elif t == "date":
                parts.append(f"{base}, 'datetime' as role, cast(0 as bigint) as unique_count, cast(null as double) as avg_length, count(*) as \"rows\" from {rel} t")
            else:
                parts.append(f"""{base}, case when al > 50 then 'text' when u <= 20 or (u <= 50 and u / n < 0.1) then 'low_cardinality' else 'other' end as role,
  u as unique_count, {r('al', 4)} as avg_length, n as "rows" from (select count(distinct {c}) as u, avg(length({c})) as al, count(*) as n from {rel} t)""")
    return union(parts)


def _contains_any(x, parts):
    return "(" + " or ".join(f"contains({x}, '{p}')" for p in parts) + ")"


def _domain_sql() -> str:
    hits = union([f"select dataset_id, {i} as place, '{d}' as domain, " + " + ".join(f"cast(contains(names, '{p}') as int)" for p in parts) + " as score from nm"
                  for i, (d, parts) in enumerate(DOMAIN_PARTS.items())])
    return f"""nm as (select dataset_id, string_agg(lower(name), ' ' order by position) as names from ro group by 1),
sc as ({hits}),
dm as (select dataset_id, case when max(score) > 0 then arg_max(domain, (score, -place)) else '' end as domain from sc group by 1)"""


_TARGET = f"""ch as (select *, max(position) over (partition by dataset_id) as last from ro),
cq as (select *, case when role = 'low_cardinality' and {_contains_any('lower(name)', TARGET_PARTS)} then 1 when role = 'numeric' and
  {_contains_any('lower(name)', TARGET_PARTS)} then 2 when position = last and role in ('low_cardinality', 'numeric') then 3 end as choice from ch),
tg as (select dataset_id, arg_min(name, (choice, position)) as target, arg_min(role, (choice, position)) as role, arg_min(unique_count, (choice, position)) as classes
  from cq where choice is not null group by 1),
ta as (select dataset_id, target, (role = 'low_cardinality' or classes <= 10) as is_categorical, classes from tg),
tt as (select dataset_id, arg_max(name, position) as target from ro where role = 'numeric' group by 1)"""


def _sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _cases_sql(task: str, domain: str) -> str:
    whens = []
    for t, domains in USE_CASES.items():
        for dom, cases in domains.items():
            merged = list(dict.fromkeys(cases + domains["general"]))[:5]
            whens.append(f"when {task} = '{t}' and {domain} = '{dom}' then {_sql_list(merged)}")
        whens.append(f"when {task} = '{t}' then {_sql_list(domains['general'])}")
    return "case " + " ".join(whens) + " else [] end"


_MODELS = f"""case cs when 'time' then {_sql_list(MODELS['time-series'])} when 'text' then {_sql_list(MODELS['text'])} when 'number' then {_sql_list(MODELS['regression'])}
 when 'groups' then {_sql_list(MODELS['clustering'])} when 'unknown' then {_sql_list(MODELS['unknown'])} else case when classes = 2 then {_sql_list(MODELS['two classes'])}
 when classes <= 10 then {_sql_list(MODELS['few classes'])} else {_sql_list(MODELS['many classes'])} end end"""

RECOMMENDED = JUDGED + ["customer", "events"]
_RO = f"ro as materialized ({_roles_sql(RECOMMENDED)}), {_domain_sql()}, {_TARGET}"
_REC = f"""fa as (select dataset_id, count(case when role = 'datetime' then 1 end) as dates, count(case when role = 'text' then 1 end) as texts,
  count(case when role = 'numeric' then 1 end) as nums, arg_min(case when role = 'low_cardinality' then name end, case when role = 'low_cardinality' then position end) as first_low
  from ro group by 1),
rj as (select fa.*, domain, ta.target, is_categorical, classes, tt.target as time_target, case when dates > 0 then 'time' when texts > 0 then 'text' when is_categorical then 'classes'
  when ta.target is not null then 'number' when nums >= 3 then 'groups' else 'unknown' end as cs
  from fa left join dm using (dataset_id) left join ta using (dataset_id) left join tt using (dataset_id)),
rk as (select *, case cs when 'time' then 'time-series' when 'number' then 'regression' when 'groups' then 'clustering' else 'classification' end as task,
  case when cs = 'text' and domain = '' then 'text' else domain end as dom from rj),
rec as (select dataset_id, task, cast(case cs when 'time' then 85 when 'text' then 78 when 'classes' then 88 when 'number' then 85 when 'groups' then 60 else 40 end as bigint) as confidence,
  array_to_string({_MODELS}, '|') as models, case cs when 'time' then time_target when 'text' then first_low when 'classes' then target when 'number' then target end as target,
  array_to_string(case when cs = 'unknown' then ['general classification', 'exploratory analysis'] else {_cases_sql('task', 'dom')} end, '|') as use_cases from rk)"""


def all_roles(spark, d):
    more = lambda n: _cached(spark, d, "roles " + n, lambda: column_roles(table(spark, d, n), n))
    return reduce(lambda a, b: a.unionByName(b), [roles(spark, d)] + [more(n) for n in ("customer", "events")])


def _role_rows(spark, d):
    unique = F.when(F.col("role") == "datetime", F.lit(0)).otherwise(F.col("unique_count"))
    return tidy(all_roles(spark, d).withColumn("unique_count", unique))


# ---- all warnings of the judged tables -------------------------------------------------
_TARGETS = {"duped": "l_returnflag", "orders": "o_totalprice", "documents": "lang", "labels": "quality"}
_BIAS = f"""fg as materialized ({union([_figures(n) for n in JUDGED])}),
bw as (
select w.* from rec join ({union([f"select * from ({_imbalance_sql(n, c)})" for n in JUDGED for c, _ in COLUMNS[n]])}) w
  on rec.dataset_id = w.dataset_id and rec.target = w.affected_columns
union all {_SKEW}
union all {_DOM}
union all {_OUT}
union all {_LOW}
union all {_proxy_sql(JUDGED)})"""
_RO4 = _RO.replace(_roles_sql(RECOMMENDED), _roles_sql(JUDGED))

_STEPS = """st as (select m.*, k.constants, k.nums, k.strs, coalesce(i.twins, false) as twins, coalesce(i.skewed, false) as skewed, coalesce(w.imb, false) as imb,
  coalesce(w.high, false) as high, coalesce(w.outl, false) as outl, rec.task from m
  left join (select dataset_id, count(case when unique_count <= 1 then 1 end) as constants, count(case when type = 'number' then 1 end) as nums,
    count(case when type = 'string' then 1 end) as strs from c group by 1) k using (dataset_id)
  left join (select dataset_id, bool_or(category = 'correlation' and severity = 'critical') as twins,
    bool_or(category = 'distribution' and severity in ('warning', 'critical')) as skewed from ins group by 1) i using (dataset_id)
  left join (select dataset_id, bool_or(type = 'class_imbalance') as imb, bool_or(type = 'class_imbalance' and severity = 'high') as high,
    bool_or(type = 'outlier_heavy') as outl from bw group by 1) w using (dataset_id)
  left join rec using (dataset_id)),
sx as (
select dataset_id, 1 as no, 'preprocess' as action_type, 'handle_missing' as action_key, missing_pct > 15 as is_critical from st where missing_pct > 0
union all select dataset_id, 2, 'preprocess', 'remove_duplicates', duplicate_pct > 10 from st where duplicate_pct > 2
union all select dataset_id, 3, 'preprocess', 'drop_low_variance', false from st where constants > 0
union all select dataset_id, 4, 'preprocess', 'remove_correlated', false from st where twins
union all select dataset_id, 5, 'preprocess', 'handle_skewness', false from st where skewed
union all select dataset_id, 6, 'info', null, high from st where imb
union all select dataset_id, 7, 'preprocess', 'remove_outliers', false from st where outl
union all select dataset_id, 8, 'preprocess', 'normalize', false from st where nums >= 2
union all select dataset_id, 9, 'preprocess', 'encode_categorical', false from st where strs > 0
union all select dataset_id, 10, 'model', null, false from st
union all select dataset_id, 11, 'model', null, false from st where task <> ''
union all select dataset_id, 12, 'info', null, false from st)"""

# ---- comparison ---------------------------------------------------------------------
PAIRS = [("documents", "duped"), ("duped", "orders"), ("labels", "orders"), ("documents", "labels")]
_PAIRS_SQL = union([f"select '{a}' as id_a, '{b}' as id_b" for a, b in PAIRS])
_SUMMARY = f"""sm as (select m.*, o.score, {_LABEL.replace('score', 'o.score')} as quality, numbers, strings, avg_nulls,
  case when top >= 0.9 then 'strong' when top >= 0.7 then 'moderate' when top >= 0.4 then 'weak' else 'none' end as correlation_strength, rec.task, rec.target
  from m join o using (dataset_id)
  left join (select dataset_id, count(case when type = 'number' then 1 end) as numbers, count(case when type = 'string' then 1 end) as strings,
    {r('sum(null_count) / count(*)', 1)} as avg_nulls from c group by 1) k using (dataset_id)
  left join (select dataset_id, max(abs(value)) as top from r group by 1) t using (dataset_id)
  left join rec using (dataset_id))"""


def _metric(name, a_wins, b_wins, va, vb, weight):
    return (f"select id_a, id_b, '{name}' as metric, {va} as value_a, {vb} as value_b, case when {a_wins} then id_a when {b_wins} then id_b else 'tie' end as winner, "
            f"{big(weight)} as weight from pr")


def _sides(c, test):
    return test.format(x=f"a_{c}", y=f"b_{c}"), test.format(x=f"b_{c}", y=f"a_{c}")


def _bal(s):
    return f"coalesce(least({s}_numbers, {s}_strings) / nullif(greatest({s}_numbers, {s}_strings), 0), 0.0)"


_COMPARE = f"""pr as (select p.*, {', '.join(f'{s}.{c} as {s}_{c}' for s in 'ab' for c in ('rows', 'columns', 'missing_pct', 'duplicate_pct', 'score', 'numbers', 'strings', 'task'))}
  from ({_PAIRS_SQL}) p join sm a on a.dataset_id = id_a join sm b on b.dataset_id = id_b),
cm as (
{_metric('rows', *_sides('rows', '{x} > {y} * 1.1'), 'cast(a_rows as varchar)', 'cast(b_rows as varchar)', 1)}
union all {_metric('columns', *_sides('columns', '{x} > {y}'), 'cast(a_columns as varchar)', 'cast(b_columns as varchar)', 1)}
union all {_metric('missing', *_sides('missing_pct', '{x} < {y} - 0.5'), fx('a_missing_pct', 2) + " || '%'", fx('b_missing_pct', 2) + " || '%'", 2)}
union all {_metric('duplicates', *_sides('duplicate_pct', '{x} < {y} - 0.5'), fx('a_duplicate_pct', 2) + " || '%'", fx('b_duplicate_pct', 2) + " || '%'", 1)}
union all {_metric('quality', *_sides('score', '{x} > {y} + 3'), fx('a_score', 1), fx('b_score', 1), 2)}
union all {_metric('balance', f"{_bal('a')} > {_bal('b')}", f"{_bal('b')} > {_bal('a')}", "a_numbers || ' numeric, ' || a_strings || ' text'", "b_numbers || ' numeric, ' || b_strings || ' text'", 1)}
union all {_metric('task', 'false', 'false', "coalesce(nullif(a_task, ''), 'unknown')", "coalesce(nullif(b_task, ''), 'unknown')", 0)})"""


def _all_ctes(*more):
    return ",\n".join([_ALL, _INS, _FACTS, _SCORE, _RO4, _REC, *more])


def _recommended(spark, d):
    return recommend(roles(spark, d))


def _summary(spark, d):
    p = profiles(spark, d)
    return dataset_summary(p, recommend(roles(spark, d, p)))


def _pairs(spark):
    return local_table(spark, [{"id_a": a, "id_b": b} for a, b in PAIRS], "id_a string, id_b string")


def _labeled(spark, d):
    return derived(spark, d, LABELED)


QUERIES = {
    "quality_score": (lambda s, d: quality_score(profiles(s, d)).select("dataset_id", "name", "score", "max_score", "label"),
                      f"{_MC} select dataset_id, name, cast(score as double) as score, cast(max_score as double) as max_score, label from s"),
    "quality_overall": (lambda s, d: overall_score(profiles(s, d)).select("dataset_id", "score", "quality"),
                        f"{_MC} select dataset_id, score, {_LABEL} as quality from o"),
    "quality_label": (lambda s, d: table(s, d, "orders").select("o_orderkey", quality_label(F.col("o_totalprice") / 5000).alias("quality")),
                      "select o_orderkey, case when o_totalprice / 5000 >= 70 then 'high' when o_totalprice / 5000 >= 40 then 'medium' else 'low' end as quality from orders"),
    "insights": (lambda s, d: tidy(insights(profiles(s, d)).select("dataset_id", "ord", "rule", "severity", "category", "evidence")),
                 f"{_ALL}, {_INS} select dataset_id, cast(ord as bigint) as ord, rule, severity, category, evidence from ins"),
    "bias_class_imbalance": (lambda s, d: _pick(B.class_imbalance(_labeled(s, d), "toxic", "labeled").unionByName(
        B.class_imbalance(table(s, d, "orders"), "o_orderstatus", "orders")).unionByName(B.class_imbalance(table(s, d, "labels"), "quality", "labels"))),
        union([_imbalance_sql("labeled", "toxic", f"({duck(LABELED)})"), _imbalance_sql("orders", "o_orderstatus"), _imbalance_sql("labels", "quality")])),
    "class_balance": (lambda s, d: tidy(B.class_balance(table(s, d, "labels"), "quality")),
                      f"""select count(*) as classes, cast(sum(k) as bigint) as total, arg_min(v, (-k, v)) as dominant, arg_max(v, (-k, v)) as minority,
                      {r('max(k) * 100.0 / sum(k)', 6)} as dominant_pct, {r('min(k) * 100.0 / sum(k)', 6)} as minority_pct
                      from (select cast(quality as varchar) as v, count(*) as k from labels group by 1)"""),
    "bias_figures": (lambda s, d: tidy(B.figures_table(table(s, d, "duped")).select("column", "position", "non_null", "skew", "outlier_pct"), 4),
                     f"with fg as ({_figures('duped')}) select \"column\", position, non_null, {r('skew', 4)} as skew, {r('outlier_pct', 4)} as outlier_pct from fg"),
    "bias_skewness": (lambda s, d: _pick(B.skewness(table(s, d, "documents"), "documents").unionByName(B.skewness(table(s, d, "labels"), "labels"))),
                      f"with fg as ({union([_figures('documents'), _figures('labels')])}) {_SKEW}"),
    "bias_dominance": (lambda s, d: _pick(B.dominance(derived(s, d, DOMINATED), "dominated")), f"{_figures_of('dominated', DOMINATED)} {_DOM}"),
    "bias_outliers": (lambda s, d: _pick(B.outliers(derived(s, d, HEAVY), "heavy")), f"{_figures_of('heavy', HEAVY)} {_OUT}"),
    "bias_low_variance": (lambda s, d: _pick(B.low_variance(_flats(s, d), "flats")), f"{_figures_of('flats', FLATS)} {_LOW}"),
    "bias_proxy": (lambda s, d: _pick(B.proxy(derived(s, d, PEOPLE.replace('"', "`")), "people")),
                   "select 'people' as dataset_id, cast(6 as bigint) as ord, 'proxy_variable' as type, 'medium' as severity, "
                   "string_agg(n, '|' order by i) as affected_columns from (select unnest(['customer_id', 'name', 'nationality_code', 'Marital-Status', 'zip_code', "
                   "'average_balance']) as n, unnest(range(6)) as i) where " + _contains_any("replace(replace(lower(n), '_', ''), '-', '')", SENSITIVE_PARTS)),
    "bias_sorted": (lambda s, d: tidy(B.bias_sorted(warnings(s, d)).select("dataset_id", "ord", "type", "severity", "affected_columns", "severity_rank")),
                    f"{_all_ctes(_BIAS)} select *, cast(case severity when 'high' then 0 when 'medium' then 1 else 2 end as bigint) as severity_rank from bw"),
    "bias_warnings": (lambda s, d: _pick(warnings(s, d)), f"{_all_ctes(_BIAS)} select * from bw"),
    "column_roles": (_role_rows, _roles_sql(RECOMMENDED)),
    "detect_domain": (lambda s, d: detect_domain(all_roles(s, d)), f"with {_RO} select * from dm"),
    "detect_target": (lambda s, d: detect_target(all_roles(s, d)), f"with {_RO} select * from ta"),
    "pick_time_target": (lambda s, d: pick_time_target(all_roles(s, d)), f"with {_RO} select * from tt"),
    "recommend_task": (lambda s, d: tidy(recommend(all_roles(s, d)).drop("reasoning")), f"with {_RO}, {_REC} select * from rec"),
    "class_models": (lambda s, d: tidy(table(s, d, "labels").groupBy().agg(F.count_distinct("quality").alias("classes")).unionByName(
        table(s, d, "part").groupBy().agg(F.count_distinct("p_brand").alias("classes"))).unionByName(table(s, d, "part").groupBy().agg(F.count_distinct("p_type").alias("classes")))
        .select("classes", class_models(F.col("classes")).alias("models"))),
        f"""select classes, array_to_string(case when classes = 2 then {_sql_list(MODELS['two classes'])} when classes <= 10 then {_sql_list(MODELS['few classes'])}
        else {_sql_list(MODELS['many classes'])} end, '|') as models from (select count(distinct quality) as classes from labels
        union all select count(distinct p_brand) from part union all select count(distinct p_type) from part)"""),
    "use_cases": (lambda s, d: tidy(detect_domain(all_roles(s, d)).withColumn("task", F.explode(F.array(*[F.lit(t) for t in USE_CASES])))
                                    .withColumn("use_cases", use_cases(F.col("task"), F.col("domain")))),
                  f"with {_RO}, x as (select dm.*, unnest({_sql_list(list(USE_CASES))}) as task from dm) select dataset_id, domain, task, "
                  f"array_to_string({_cases_sql('task', 'domain')}, '|') as use_cases from x"),
    "next_steps": (lambda s, d: tidy(next_steps(profiles(s, d), insights(profiles(s, d)), warnings(s, d), _recommended(s, d))
                                     .select("dataset_id", "ord", "action_type", "action_key", "is_critical")),
                   f"{_all_ctes(_BIAS, _STEPS)} select dataset_id, row_number() over (partition by dataset_id order by no) as ord, action_type, action_key, is_critical from sx"),
    "dataset_summary": (lambda s, d: tidy(_summary(s, d)), f"{_all_ctes(_SUMMARY)} select * from sm"),
    "compare_pairs": (lambda s, d: tidy(compare(_summary(s, d), _pairs(s)).drop("explanation")), f"{_all_ctes(_SUMMARY, _COMPARE)} select * from cm"),
    "compare_winner": (lambda s, d: compare_winner(compare(_summary(s, d), _pairs(s)), _summary(s, d)).drop("explanation"),
                       f"""{_all_ctes(_SUMMARY, _COMPARE)}, pt as (select id_a, id_b, cast(sum(case when winner = id_a then weight else 0 end) as bigint) as points_a,
                       cast(sum(case when winner = id_b then weight else 0 end) as bigint) as points_b from cm group by 1, 2)
                       select pt.id_a, pt.id_b, points_a, points_b, case when points_a > points_b or (points_a = points_b and a_score >= b_score) then pt.id_a else pt.id_b end as best
                       from pt join pr on pt.id_a = pr.id_a and pt.id_b = pr.id_b"""),
}
