"""DuckDB text of the profile tables, generated per input table."""

from __future__ import annotations

from .base import COLUMNS, big, fmt_number, histogram_sql, numbers, r, relation, texts, top_sql, union

STURGES_10 = "least(10, greatest(6, cast(floor(log2(n) + 1) as int)))"
STURGES_30 = "least(30, greatest(6, cast(floor(log2(n) + 1) as int)))"


def metrics(name: str) -> str:
    rel, cols = relation(name), [c for c, _ in COLUMNS[name]]
    filled = " + ".join(f"count({c})" for c in cols)
    return f"""select '{name}' as dataset_id, count(*) as "rows", {big(len(cols))} as columns,
  {r(f'(count(*) * {len(cols)} - ({filled})) * 100.0 / (count(*) * {len(cols)})', 2)} as missing_pct,
  (select {r('(sum(k) - count(*)) * 100.0 / sum(k)', 2)} from (select count(*) as k from {rel} s group by {', '.join(cols)})) as duplicate_pct
from {rel} t"""


def columns(name: str) -> str:
    rel = relation(name)
    return union([f"select '{name}' as dataset_id, {big(i)} as position, '{c}' as name, '{t}' as type, count(*) - count({c}) as null_count, "
                  f"count(distinct {c}) as unique_count from {rel} t" for i, (c, t) in enumerate(COLUMNS[name])])


def correlations(name: str, top: int = 20) -> str:
    rel, cols = relation(name), numbers(name)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    aggs = ", ".join(f"case when count(case when {cols[i]} is not null and {cols[j]} is not null then 1 end) >= 10 "
                     f"then corr({cols[i]}, {cols[j]}) end as v{i}_{j}" for i, j in pairs)
    rows = union([f"select {i} as i, {j} as j, '{cols[i]}' as column1, '{cols[j]}' as column2, v{i}_{j} as v from a" for i, j in pairs])
    return f"""select '{name}' as dataset_id, rank, column1, column2, value from (
  select *, row_number() over (order by abs(value) desc, i, j) as rank from (
    with a as (select {aggs} from {rel} t), u as ({rows})
    select i, j, column1, column2, {r('v', 4)} as value from u where v is not null and not isnan(v) and not isinf(v)))
where rank <= {top}"""


def _variance_order(name: str) -> str:
    rel, cols = relation(name), numbers(name)
    return union([f"select '{c}' as c, {i} as pos, var_samp({c}) as v from {rel} t" for i, c in enumerate(cols)])


def numeric_distributions(name: str, keep: int = 8) -> str:
    cols, rel = numbers(name), relation(name)
    parts = []
    for c in cols:
        parts.append(f"""select * from (with {histogram_sql(rel, c, STURGES_10)}
  select '{name}' as dataset_id, '{c}' as "column", 'numeric' as kind, {big('bin')} as bin,
         {fmt_number('lo')} || '–' || {fmt_number('hi')} as label, lo, hi, cnt as "count" from g where n >= 5)""")
    out = union(parts)
    if len(cols) <= keep:
        return out
    return f"""select d.* from ({out}) d join (select c from ({_variance_order(name)}) order by v desc, pos limit {keep}) k on d."column" = k.c"""


def categorical_distributions(name: str, uniques: dict | None = None, keep: int = 4) -> str:
    """Gates: 2-50 distinct values, or 2-200 when no column has 2-50."""
    cols, rel = texts(name), relation(name)
    if not cols:
        return ""
    gate = union([f"select '{c}' as c, {i} as pos, count(distinct {c}) as u from {rel} t" for i, c in enumerate(cols)])
    chosen = f"""(with q as ({gate}) select c from q where u >= 2 and u <= case when exists (select 1 from q where u between 2 and 50) then 50 else 200 end
  order by pos limit {keep})"""
    parts = [f"""select * from (with {top_sql(rel, c, 10)}
  select '{name}' as dataset_id, '{c}' as "column", 'categorical' as kind, {big('bin')} as bin, substr(value, 1, 30) as label,
         cast(null as double) as lo, cast(null as double) as hi, cnt as "count" from shown)""" for c in cols]
    return f"""select d.* from ({union(parts)}) d join {chosen} k on d."column" = k.c"""


def distributions(name: str) -> str:
    return union([x for x in (numeric_distributions(name), categorical_distributions(name)) if x])


def profile_ctes(names: list[str], parts: tuple[str, ...] = ("m", "c", "r", "d")) -> str:
    """m, c, r, d: metrics, columns, correlations and distributions of all tables."""
    make = {"m": metrics, "c": columns, "r": correlations, "d": distributions}
    return ",\n".join(f"{p} as materialized ({union([f'select * from ({make[p](n)})' for n in names])})" for p in parts)
