"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import missing as M
from ..operators.encode import encode_label, encode_onehot
from ..operators.power import apply_exponents, best_exponents, handle_skewness
from ..plans.prep import apply_steps, run_steps
from ..session import local_table
from .base import COLUMNS, CUSTOMER_GAPS, DIRTY, DUPED, SUPPLIER_GAPS, derived, duck, numbers, r, read, relation, skew, table, texts, tidy

_D, _DD = relation("dirty"), relation("duped")
_COLS = [c for c, _ in COLUMNS["dirty"]]
_NUM, _TXT = numbers("dirty"), texts("dirty")
_GAPPY = {"l_tax", "l_discount", "l_suppkey", "l_returnflag"}
_ALL_NAMES = ", ".join(_COLS)
COLUMNS["ev"] = [("event_id", "number"), ("user_id", "number"), ("value", "number")]


def _select(changed: dict[str, str], cols=_COLS, drop=()) -> str:
    """Every column, rounded like tidy() does, with some replaced."""
    out = []
    for c in cols:
        if c in drop:
            continue
        kind = dict(COLUMNS["dirty"]).get(c, "number")
        expr = changed.get(c, c)
        if kind == "number" and (c in changed or c in ("l_quantity", "l_extendedprice", "l_tax", "l_discount", "const_col", "qty_twin")):
            expr = r(expr, 6)
        elif kind == "number":
            expr = f"cast({expr} as bigint)"
        out.append(f"{expr} as {c}")
    return ", ".join(out)


def _mode(c, rel):
    return f"(select {c} from {rel} t where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"


def _fill(agg: str) -> str:
    changed = {}
    for c in _GAPPY:
        if c in _TXT:
            changed[c] = f"coalesce({c}, {_mode(c, 'base')})"
        elif agg == "mode":
            changed[c] = f"coalesce({c}, {_mode(c, 'base')})"
        else:
            changed[c] = f"coalesce(cast({c} as double), (select {agg.format(c=c)} from base))"
    text = _select(changed)
    if agg == "mode":
        text = text.replace(r(changed["l_suppkey"], 6), f"cast({changed['l_suppkey']} as bigint)")
    return f"with base as materialized (select * from {_D} t) select {text} from base"


def _dirty(spark, d):
    return derived(spark, d, DIRTY)


# ---- neighbours on whole small tables: brute force in SQL ---------------------------


def knn_sql(rel: str, cols: list[str], keep: list[str], k: int = 5, text_mode: list[str] = ()) -> str:
    """Every gap against every row that has the value, NaN-Euclidean, mean of the k nearest."""
    p = len(cols)
    shared = " + ".join(f"(case when q.{c} is not null and x.{c} is not null then 1 else 0 end)" for c in cols)
    total = " + ".join(f"coalesce((q.{c} - x.{c}) * (q.{c} - x.{c}), 0.0)" for c in cols)
    casts = ", ".join([f"cast({c} as double) as {c}" for c in cols] + [c for c in keep if c not in cols])
    fills = ",\n".join(f"""fill_{c} as (select rid, avg(v) as v from (
  select q.rid, x.{c} as v, row_number() over (partition by q.rid order by ({total}) * ({p} / ({shared})), x.{c}) as rn
  from base q join base x on q.{c} is null and x.{c} is not null and ({shared}) > 0) where rn <= {k} group by rid)""" for c in cols)
    joins = " ".join(f"left join fill_{c} on base.rid = fill_{c}.rid" for c in cols)
    out = ", ".join([f"{r(f'coalesce(base.{c}, fill_{c}.v, (select avg({c}) from base))', 6)} as {c}" for c in cols]
                    + [f"coalesce(base.{c}, {_mode(c, 'base')}) as {c}" if c in text_mode else f"base.{c}" for c in keep if c not in cols])
    return f"with base as materialized (select row_number() over () as rid, {casts} from {rel} t),\n{fills}\nselect {out} from base {joins}"


# One gap column and one other: the regression settles in the first round, and its evidence maximisation is a recursion over two precisions.
PRICE_GAPS = """select l_quantity, case when l_orderkey % 13 = 4 then null else l_extendedprice end as l_extendedprice, l_returnflag from {lineitem}"""
_CHAINED_SQL = f"""with recursive base as materialized (select cast(l_quantity as double) as x, cast(l_extendedprice as double) as y, l_returnflag from ({duck(PRICE_GAPS)}) t),
m as materialized (select cast(count(*) as double) as n, avg(x) as mx, avg(y) as my, regr_sxx(y, x) as xx, regr_sxy(y, x) as xy, regr_syy(y, x) as yy from base where y is not null),
fit as (select 0 as step, 1.0 / (yy / n + 2.220446049250313e-16) as alpha, cast(1.0 as double) as lam, cast(0.0 as double) as w, false as done from m
  union all
  select step + 1, (n - alpha * xx / (lam + alpha * xx) + 2e-6) / (greatest(yy - 2 * v * xy + v * v * xx, 0.0) + 2e-6),
         (alpha * xx / (lam + alpha * xx) + 2e-6) / (v * v + 2e-6), v, step > 0 and abs(w - v) < 1e-3
  from (select *, xy / (xx + lam / alpha) as v from fit, m) where step < 300 and not done),
line as (select xy / (xx + lam / alpha) as w, mx, my from fit, m order by step desc limit 1)
select {r('x', 4)} as l_quantity, {r('coalesce(y, my + w * (x - mx))', 4)} as l_extendedprice, l_returnflag from base, line"""

_SUP, _CUS = f"({duck(SUPPLIER_GAPS)})", f"({duck(CUSTOMER_GAPS)})"
_SUP_NUM = ["s_suppkey", "s_nationkey", "s_acctbal"]

# smart on the customer table: both numeric gaps are above 5%, so they are the only features.
_SMART = knn_sql(_CUS, ["c_nationkey", "c_acctbal"], ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], text_mode=["c_mktsegment"])

# smart on lineitem: l_suppkey is dropped; l_discount is the only column in the neighbour
# tier, so no row shares a feature with its gaps and they get the mean; l_tax the median.
_SMART_DIRTY = f"""with base as materialized (select * from {_D} t) select """ + _select({
    "l_tax": "coalesce(l_tax, (select quantile_cont(l_tax, 0.5) from base))", "l_discount": "coalesce(l_discount, (select avg(l_discount) from base))",
    "l_returnflag": f"coalesce(l_returnflag, {_mode('l_returnflag', 'base')})"}, drop=("l_suppkey",)) + " from base"

# ---- outliers -------------------------------------------------------------------------


def _chain(kind: str, cols: list[str], t: float) -> str:
    steps = ["s0 as materialized (select * from events)"]
    for i, c in enumerate(cols):
        src, dst = f"s{i}", f"s{i + 1}"
        if kind == "iqr":
            q = f"(select quantile_cont(cast({c} as double), 0.25) as a, quantile_cont(cast({c} as double), 0.75) as b from {src})"
            steps.append(f"{dst} as materialized (select {src}.* from {src}, {q} q where not (b - a > 0) or {c} is null or ({c} >= a - {t} * (b - a) and {c} <= b + {t} * (b - a)))")
        else:
            q = f"(select avg(x) as m, stddev_pop(x) as s from (select coalesce(cast({c} as double), (select quantile_cont(cast({c} as double), 0.5) from {src})) as x from {src}))"
            steps.append(f"{dst} as materialized (select {src}.* from {src}, {q} q where {c} is null or abs(({c} - m) / nullif(s, 0)) < {t})")
    return "with " + ",\n".join(steps) + f" select event_id, ts, user_id, event_type, {r('value', 6)} as value, props from s{len(cols)}"


def _joint_sql(cols, t=1.5):
    limits = ", ".join(f"quantile_cont(cast({c} as double), 0.25) as a{i}, quantile_cont(cast({c} as double), 0.75) as b{i}" for i, c in enumerate(cols))
    cond = " and ".join(f"(not (b{i} - a{i} > 0) or {c} is null or ({c} >= a{i} - {t} * (b{i} - a{i}) and {c} <= b{i} + {t} * (b{i} - a{i})))" for i, c in enumerate(cols))
    return f"select event_id, ts, user_id, event_type, {r('value', 6)} as value, props from events, (select {limits} from events) q where {cond}"


_EV = ["event_id", "user_id", "value"]


# ---- scaling --------------------------------------------------------------------------


def _scale(kind: str) -> str:
    changed = {}
    aggs = []
    for i, c in enumerate(_NUM):
        x = f"cast({c} as double)"
        if kind == "minmax":
            aggs.append(f"min({x}) as a{i}, case when max({x}) = min({x}) then 1.0 else max({x}) - min({x}) end as b{i}")
        elif kind == "zscore":
            aggs.append(f"case when max({x}) = min({x}) then min({x}) else avg({x}) end as a{i}, case when max({x}) = min({x}) then 1.0 else stddev_pop({x}) end as b{i}")
        else:
            aggs.append(f"quantile_cont({x}, 0.5) as a{i}, case when quantile_cont({x}, 0.75) = quantile_cont({x}, 0.25) then 1.0 "
                        f"else quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) end as b{i}")
        changed[c] = f"({c} - a{i}) / b{i}"
    return f"with base as materialized (select * from {_D} t), q as (select {', '.join(aggs)} from base) select {_select(changed)} from base, q"


def _skew_sql(fn: str) -> str:
    return f"""with q as (select {skew('n_chars')} as sk, count(n_chars) as n, min(n_chars) as lo from documents)
select doc_id, text, lang, source, {r(f"case when n >= 10 and abs(sk) > 1 and lo {'>' if fn == 'ln(1 + n_chars)' else '>='} 0 then {fn} else n_chars end", 6)} as n_chars from documents, q"""


# ---- encoding -------------------------------------------------------------------------


def _label_sql(cols, rel, keep):
    out = ", ".join(f"d_{c}.code as {c}" if c in cols else c for c in keep)
    ctes = ", ".join(f"d_{c} as (select v, row_number() over (order by v) - 1 as code from (select distinct coalesce({c}, 'nan') as v from base))" for c in cols)
    joins = " ".join(f"join d_{c} on d_{c}.v = coalesce(base.{c}, 'nan')" for c in cols)
    return f"with base as materialized (select * from {rel} t), {ctes} select {out} from base {joins}"


def _onehot(spark, d):
    return tidy(encode_onehot(derived(spark, d, CUSTOMER_GAPS)))


_ONEHOT = f"""with base as materialized (select * from {_CUS} t), d as (select v, row_number() over (order by v) - 1 as code from (select distinct c_name as v from base))
select c_custkey, d.code as c_name, cast(c_nationkey as bigint) as c_nationkey, {r('c_acctbal', 6)} as c_acctbal, """ + ", ".join(
    f"cast(coalesce(c_mktsegment = '{v}', false) as bigint) as \"c_mktsegment_{v}\"" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + """
from base join d on d.v = base.c_name"""

# ---- steps ----------------------------------------------------------------------------
STEPS = [
    {"action": "remove_duplicates", "params": {}},
    {"action": "handle_missing", "params": {"strategy": "drop_cols"}},
    {"action": "handle_missing", "params": {"strategy": "median"}},
    {"action": "no_such_action", "params": {}},
    {"action": "remove_correlated", "params": {"threshold": 0.95}},
    {"action": "drop_low_variance", "params": {}},
    {"action": "normalize", "params": {"method": "minmax", "columns": ["l_extendedprice", "l_tax"]}},
]
_STEPPED = f"""with a as materialized (select distinct * from {_DD} t), q as (select min(l_extendedprice) as x0, max(l_extendedprice) as x1, min(l_tax) as t0, max(l_tax) as t1 from a)
select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, {r('(l_extendedprice - x0) / (x1 - x0)', 6)} as l_extendedprice,
  {r('(coalesce(l_tax, (select quantile_cont(l_tax, 0.5) from a)) - t0) / (t1 - t0)', 6)} as l_tax,
  {r('coalesce(l_discount, (select quantile_cont(l_discount, 0.5) from a))', 6)} as l_discount,
  coalesce(l_returnflag, {_mode('l_returnflag', 'a')}) as l_returnflag, l_linestatus, {r('qty_twin', 6)} as qty_twin from a, q"""


def _prep_report(spark, d):
    return tidy(run_steps(derived(spark, d, DUPED), STEPS, "duped").report.drop("summary"))


_REPORT = f"""select 'duped' as dataset_id, 'remove_duplicates|handle_missing|handle_missing|remove_correlated|drop_low_variance|normalize' as applied_steps,
  (select count(*) from {_DD} t) - (select count(*) from (select distinct * from {_DD} t)) as rows_removed, cast(3 as bigint) as columns_removed, cast(0 as bigint) as columns_added"""


# Box-Cox only takes positive values, so it is fitted on columns that have no zero.
FITTED = [("yeo_johnson", "documents", "n_chars"), ("yeo_johnson", "events", "value"), ("box_cox", "documents", "n_chars"), ("box_cox", "orders", "o_totalprice")]


def _exponents(spark, d):
    rows = [{"method": m, "column": c, "lambda": best_exponents(read(spark, d, t), [c], m)[c]} for m, t, c in FITTED]
    return tidy(local_table(spark, rows, "method string, column string, lambda double"), 3)


def _transformed(spark, d, name, column, method):
    """The transform with its exponent rounded, so that both engines use the same one."""
    df = read(spark, d, name)
    lam = round(best_exponents(df, [column], method)[column], 3)
    return tidy(apply_exponents(df, {column: lam}, method), 4)


def _transformed_sql(name: str, keep: list[str], c: str, method: str) -> str:
    l = f"ln(cast({c} as double))" if method == "box_cox" else f"sign({c}) * ln(1 + abs(cast({c} as double)))"
    up, down = "case when lam = 0 then l else (exp(l * lam) - 1) / lam end", "case when lam = 2 then l else -(exp(-l * (2 - lam)) - 1) / (2 - lam) end"
    value = up if method == "box_cox" else f"case when l >= 0 then {up} else {down} end"
    out = "t" if method == "box_cox" else "(t - avg(t) over ()) / stddev_pop(t) over ()"
    return (f"with q as ({_zoom(method, name, c)}), x as (select * exclude ({c}, lam), {value} as t from (select s.*, {l} as l, {r('lam', 3)} as lam from {name} s, q)) "
            f"select {', '.join(keep)}, {r(out, 4)} as {c} from x")


def _zoom(method: str, rel: str, c: str) -> str:
    """The best exponent by three ever finer grids of the likelihood."""
    if method == "box_cox":
        logs, value = f"ln(cast({c} as double))", "case when abs(lam) < 1e-12 then l else (exp(l * lam) - 1) / lam end"
    else:
        logs = f"sign({c}) * ln(1 + abs(cast({c} as double)))"
        value = ("case when l >= 0 then case when abs(lam) < 1e-12 then l else (exp(l * lam) - 1) / lam end "
                 "else case when abs(2 - lam) < 1e-12 then l else -(exp(-l * (2 - lam)) - 1) / (2 - lam) end end")
    parts = [f"v as materialized (select {logs} as l from {rel} where {c} is not null), z0 as (select 0.0::double as lam)"]
    for k, step in enumerate((0.1, 0.004, 0.0002)):
        around = f"(select z.lam + i * {step} as lam from z{k} z, (select unnest(range(-50, 51)) as i))"
        parts.append(f"z{k + 1} as materialized (select arg_max(lam, ll) as lam from (select lam, (lam - 1) * sum(l) - count(*) / 2.0 * ln(var_pop({value})) as ll "
                     f"from v, {around} group by lam))")
    return f"select '{method}' as method, '{c}' as \"column\", lam from (with {', '.join(parts)} select lam from z3)"


_EXPONENTS = f"select method, \"column\", {r('lam', 3)} as lambda from (" + " union all ".join(
    _zoom(m, rel, c) for m, rel, c in FITTED) + ")"


QUERIES = {
    "missing_drop_rows": (lambda s, d: tidy(M.drop_rows(_dirty(s, d))), f"select {_select({})} from {_D} t where " + " and ".join(f"{c} is not null" for c in _COLS)),
    "missing_drop_cols": (lambda s, d: tidy(M.drop_cols(_dirty(s, d))), f"select {_select({}, drop=('l_suppkey',))} from {_D} t"),
    "missing_mean": (lambda s, d: tidy(M.fill_mean(_dirty(s, d))), _fill("avg({c})")),
    "missing_median": (lambda s, d: tidy(M.fill_median(_dirty(s, d))), _fill("quantile_cont(cast({c} as double), 0.5)")),
    "missing_mode": (lambda s, d: tidy(M.fill_mode(_dirty(s, d))), _fill("mode")),
    "missing_knn": (lambda s, d: tidy(M.fill_knn(derived(s, d, SUPPLIER_GAPS))), knn_sql(_SUP, _SUP_NUM, ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])),
    "missing_knn_customer": (lambda s, d: tidy(M.fill_knn(derived(s, d, CUSTOMER_GAPS))),
                             knn_sql(_CUS, ["c_custkey", "c_nationkey", "c_acctbal"], ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], text_mode=["c_mktsegment"])),
    "missing_iterative": (lambda s, d: tidy(M.fill_chained(_dirty(s, d))), None),
    "missing_iterative_single": (lambda s, d: tidy(M.fill_chained(derived(s, d, PRICE_GAPS)), 4), _CHAINED_SQL),
    "missing_smart": (lambda s, d: tidy(M.impute_smart(derived(s, d, CUSTOMER_GAPS))), _SMART),
    "missing_smart_dirty": (lambda s, d: tidy(M.impute_smart(_dirty(s, d))), _SMART_DIRTY),
    "remove_duplicates": (lambda s, d: tidy(C.remove_duplicates(table(s, d, "duped"))), f"select {_select({})} from (select distinct * from {_DD} t)"),
    "remove_correlated": (lambda s, d: tidy(C.remove_correlated(_dirty(s, d))), f"select {_select({}, drop=('l_quantity',))} from {_D} t"),
    "skew_log": (lambda s, d: tidy(handle_skewness(read(s, d, "documents"), "log")).withColumn("n_chars", F.col("n_chars").cast("double")), _skew_sql("ln(1 + n_chars)")),
    "skew_sqrt": (lambda s, d: tidy(handle_skewness(read(s, d, "documents"), "sqrt")).withColumn("n_chars", F.col("n_chars").cast("double")), _skew_sql("sqrt(n_chars)")),
    "skew_boxcox": (lambda s, d: tidy(handle_skewness(read(s, d, "events"), "box_cox")), None),
    "skew_yeojohnson": (lambda s, d: tidy(handle_skewness(read(s, d, "documents"))), None),
    "skew_exponents": (_exponents, _EXPONENTS),
    "skew_boxcox_rounded": (lambda s, d: _transformed(s, d, "documents", "n_chars", "box_cox"),
                            _transformed_sql("documents", ["doc_id", "text", "lang", "source"], "n_chars", "box_cox")),
    "skew_yeojohnson_rounded": (lambda s, d: _transformed(s, d, "documents", "n_chars", "yeo_johnson"),
                                _transformed_sql("documents", ["doc_id", "text", "lang", "source"], "n_chars", "yeo_johnson")),
    "scale_minmax": (lambda s, d: tidy(C.scale_minmax(_dirty(s, d))), _scale("minmax")),
    "scale_zscore": (lambda s, d: tidy(C.scale_zscore(_dirty(s, d))), _scale("zscore")),
    "scale_robust": (lambda s, d: tidy(C.scale_robust(_dirty(s, d))), _scale("robust")),
    "outliers_iqr": (lambda s, d: tidy(C.outliers_iqr(read(s, d, "events"))), _chain("iqr", _EV, 1.5)),
    "outliers_iqr_joint": (lambda s, d: tidy(C.outliers_iqr(read(s, d, "events"), joint=True)), _joint_sql(_EV)),
    "outliers_zscore": (lambda s, d: tidy(C.outliers_zscore(read(s, d, "events"))), _chain("zscore", _EV, 1.5)),
    "encode_onehot": (_onehot, _ONEHOT),
    "encode_label": (lambda s, d: tidy(encode_label(derived(s, d, CUSTOMER_GAPS))),
                     _label_sql(["c_name", "c_mktsegment"], f"(select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, {r('c_acctbal', 6)} as c_acctbal, c_mktsegment from {_CUS} t)",
                                ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])),
    "drop_low_variance": (lambda s, d: tidy(C.drop_low_variance(_dirty(s, d))), f"select {_select({}, drop=('const_col',))} from {_D} t"),
    "prep_steps": (lambda s, d: tidy(apply_steps(derived(s, d, DUPED), STEPS)[0]), _STEPPED),
    "prep_report": (_prep_report, _REPORT),
}
