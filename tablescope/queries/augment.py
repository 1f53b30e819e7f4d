"""Augmentation, split and baseline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.augment import augment, augment_gate, bootstrap_noise, class_distribution, smote
from ..operators.split import assign_split, baseline
from ..operators.tree import BINS, baseline_tree
from ..plans.bias import class_imbalance
from ..plans.recommend import recommend
from .base import LABELED, derived, duck, r, read, tidy
from . import judge as J

_L = f"({duck(LABELED)})"


def _labeled(s, d):
    return derived(s, d, LABELED)


def _augment_report(s, d):
    from ..session import local_table

    rows = []
    for target, task in (("quality", "classification"), ("n_chars", "regression"), ("no_such_column", "classification")):
        _, report = augment(_labeled(s, d), target, task)
        rows.append({"target": target, "success": report.success, "method": report.method, "rows_before": report.rows_before, "rows_after": report.rows_after,
                     "rows_added": report.rows_added})
    return local_table(s, rows, "target string, success boolean, method string, rows_before bigint, rows_after bigint, rows_added bigint")


def _gate(s, d):
    return tidy(augment_gate(J.profiles(s, d).metrics, J.warnings(s, d), recommend(J.roles(s, d))))


def _bootstrap_count(s, d):
    return bootstrap_noise(read(s, d, "supplier")).agg(F.count("*").alias("row_count"))


def _stratified(s, d):
    split = assign_split(_labeled(s, d), "doc_id", stratify="quality")
    return tidy(split.groupBy("quality", "split").agg(F.count("*").alias("row_count")))


def _share_sql(keys: list[str]) -> str:
    return f"cast(('0x' || substr(md5('42|' || {" || '|' || ".join(f'cast({k} as varchar)' for k in keys)}), 1, 8)) as bigint) / 4294967296.0"


def _tree_sql(rel: str, target: str, keys: list[str], columns: dict[str, str], classify: bool, depth: int, least: int) -> str:
    """The tree level by level: bins, counts by node and bin, the best split of each node, and the rows' next nodes."""
    numbers, places = [c for c, t in columns.items() if t == "number"], {c: i for i, c in enumerate(columns)}
    texts = ", ".join(str(places[c]) for c, t in columns.items() if t == "text") or "-1"
    bins = [f"cast(('0x' || substr(md5({c}), 1, 4)) as int) % {BINS} as b{i}" if t == "text" else
            f"case when hi{i} > lo{i} then greatest(0, least({BINS - 1}, cast(floor((cast({c} as double) - lo{i}) / (hi{i} - lo{i}) * {BINS}) as int))) else 0 end as b{i}"
            for i, (c, t) in enumerate(columns.items())]
    ends = ", ".join(f"cast(min({c}) as double) as lo{places[c]}, cast(max({c}) as double) as hi{places[c]}" for c in numbers)
    filled = " and ".join(f"{c} is not null" for c in [target, *columns])
    cls, weight = (f"cast({target} as varchar)", "cast(1 as double)") if classify else ("''", f"cast({target} as double)")
    out = f"""with src as materialized (select *, {_share_sql(keys)} >= 0.2 as train from ({rel}) t where {filled}), lim as (select {ends} from src where train),
d0 as materialized (select train, {cls} as cls, {weight} as w, 1 as node, {", ".join(bins)} from src, lim)"""
    for i in range(depth):
        long = " union all ".join(f"select node, {f} as f, b{f} as b, cls, count(*) as k, sum(w) as s from d{i} where train group by 1, 2, 3, 4" for f in range(len(columns)))
        side = lambda c: f"case when c.f in ({texts}) then coalesce(l.{c}, 0) else sum(coalesce(l.{c}, 0)) over (partition by c.node, c.f, c.cls order by c.b) end"
        out += f""",
l{i} as materialized ({long}), t{i} as (select node, f, cls, sum(k) as ak, sum(s) as as_ from l{i} group by 1, 2, 3),
c{i} as (select x.node, x.f, x.b, t.cls, ak, as_ from (select distinct node, f, b from l{i}) x join t{i} t on x.node = t.node and x.f = t.f),
g{i} as (select c.*, {side('k')} as lk, {side('s')} as ls from c{i} c left join l{i} l on c.node = l.node and c.f = l.f and c.b = l.b and c.cls = l.cls),
s{i} as (select node, f, b, sum(lk) as nl, sum(ak - lk) as nr, sum(ls * ls) as ql, sum((as_ - ls) * (as_ - ls)) as qr, sum(as_ * as_) as q from g{i} group by 1, 2, 3),
v{i} as (select node, f, b, {r('(ql / nl + qr / nr) - q / (nl + nr)', 6)} as gain from s{i} where nl >= {least} and nr >= {least}),
p{i} as materialized (select node as pn, f as pf, b as pb from (select *, row_number() over (partition by node order by gain desc, f, b) as rn from v{i} where gain > 0) where rn = 1),
d{i + 1} as materialized (select d.* replace (case when pn is null then node else 2 * node + case when case when pf in ({texts}) then {_at(len(columns))} = pb else {_at(len(columns))} <= pb end
  then 0 else 1 end end as node) from d{i} d left join p{i} on node = pn)"""
    last = f"d{depth}"
    if classify:
        leaf = f"select node, sum(k) as n, arg_min(cls, (-k, cls)) as prediction from (select node, cls, count(*) as k from {last} where train group by 1, 2) group by 1"
        tested = f"select d.node, count(*) as tn, sum(case when d.cls = e.prediction then 1 else 0 end) as x from {last} d join e on d.node = e.node where not train group by 1"
        shown = "prediction, cast(coalesce(tn, 0) as bigint) as test_rows, cast(coalesce(x, 0) as bigint) as test_hits"
    else:
        leaf = f"select node, count(*) as n, sum(w) / count(*) as prediction from {last} where train group by 1"
        tested = f"select d.node, count(*) as tn, sum(abs(w - prediction)) as x from {last} d join e on d.node = e.node where not train group by 1"
        shown = f"{r('prediction', 3)} as prediction, cast(coalesce(tn, 0) as bigint) as test_rows, {r('coalesce(x, 0)', 3)} as test_error"
    return f"{out}, e as materialized ({leaf}), h as ({tested}) select cast(e.node as bigint) as node, cast(n as bigint) as \"rows\", {shown} from e left join h on e.node = h.node"


def _at(columns: int) -> str:
    return "case pf " + " ".join(f"when {i} then b{i}" for i in range(columns)) + " end"


_TREE_COLUMNS = {"toxic": "number", "n_chars": "number", "text_length": "number", "lang": "text"}
_PRICE_COLUMNS = {"l_quantity": "number", "l_discount": "number", "l_tax": "number", "l_returnflag": "text", "l_linenumber": "number"}
_MD5_SHARE = "cast(('0x' || substr(md5('42|' || cast(l_orderkey as varchar) || '|' || cast(l_linenumber as varchar)), 1, 8)) as bigint) / 4294967296.0"

QUERIES = {
    "augment": (_augment_report, f"""with l as (select * from {_L} t), n as (select count(*) as n from l), k as (select max(c) * count(*) as full_size from (select count(*) as c from l group by quality))
      select 'quality' as target, true as success, 'smote' as method, n as rows_before, cast(full_size as bigint) as rows_after, cast(full_size - n as bigint) as rows_added from n, k
      union all select 'n_chars', true, 'bootstrap', n, n + least(greatest(2 * n, 1000) - n, 4 * n), least(greatest(2 * n, 1000) - n, 4 * n) from n
      union all select 'no_such_column', false, '', 0, 0, 0"""),
    "augment_classes": (lambda s, d: augment(_labeled(s, d), "quality")[1].classes,
                        f"with c as (select cast(quality as varchar) as value, count(*) as before from {_L} t group by 1) select value, before, (select max(before) from c) as after from c"),
    "smote": (lambda s, d: tidy(smote(_labeled(s, d), "quality")), None),
    "smote_classes": (lambda s, d: class_distribution(smote(_labeled(s, d), "quality"), "quality"),
                      f"with c as (select cast(quality as varchar) as value, count(*) as k from {_L} t group by 1) select value, (select max(k) from c) as count from c"),
    "bootstrap_noise": (lambda s, d: tidy(bootstrap_noise(read(s, d, "supplier"))), None),
    "bootstrap_rows": (_bootstrap_count, "select count(*) + least(greatest(2 * count(*), 1000) - count(*), 4 * count(*)) as row_count from supplier"),
    "class_distribution": (lambda s, d: class_distribution(read(s, d, "labels"), "toxic"), "select cast(toxic as varchar) as value, count(*) as count from labels group by 1"),
    "augment_gate": (_gate, f"""{J._all_ctes(J._BIAS)} select m.dataset_id, m."rows", coalesce(uneven, false) as uneven, task, target from m join rec using (dataset_id)
      left join (select distinct dataset_id, true as uneven from bw where type = 'class_imbalance') u using (dataset_id) where target is not null and (m."rows" < 1000 or uneven)"""),
    "train_test_split": (lambda s, d: assign_split(read(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber", "split").agg(F.count("*").alias("row_count"))
                         .select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "split", "row_count"),
                         f"select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, case when {_MD5_SHARE} < 0.2 then 'test' else 'train' end as split, count(*) as row_count "
                         "from lineitem group by 1, 2, 3"),
    "stratified_split": (_stratified, f"""with c as (select cast(quality as bigint) as quality, count(*) as n, cast(round(count(*) * 0.2) as bigint) as k from {_L} t group by 1)
      select quality, 'test' as split, k as row_count from c union all select quality, 'train', n - k from c"""),
    "baseline_model": (lambda s, d: baseline(_labeled(s, d), "quality", "classification", key="doc_id"), None),
    "baseline_tree": (lambda s, d: tidy(baseline_tree(_labeled(s, d), "quality", "doc_id", columns=list(_TREE_COLUMNS))),
                      _tree_sql(duck(LABELED), "quality", ["doc_id"], _TREE_COLUMNS, True, 3, 5)),
    "baseline_tree_regression": (lambda s, d: tidy(baseline_tree(read(s, d, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber"], classify=False, columns=list(_PRICE_COLUMNS)), 3),
                                 _tree_sql("select * from lineitem", "l_extendedprice", ["l_orderkey", "l_linenumber"], _PRICE_COLUMNS, False, 3, 5)),
    "baseline_regression": (lambda s, d: baseline(_labeled(s, d), "n_chars", "regression", key="doc_id"), None),
}
