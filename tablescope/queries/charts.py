"""Chart queries: points or bars, and the statistics next to them."""

from __future__ import annotations

from ..operators import charts as C
from . import judge as J
from . import sqlprofile as S
from .base import JUDGED, big, fx, histogram_sql, kurt, numbers, r, read, skew, tidy, top_sql, union


def _both(make):
    """(points query, stats query) of one chart."""
    return lambda s, d: tidy(make(s, d)[0]), lambda s, d: tidy(make(s, d)[1])


_hist = _both(lambda s, d: C.histogram(read(s, d, "events"), "value"))
_density = _both(lambda s, d: C.histogram(read(s, d, "documents"), "n_chars", bins=20, normalize=True))
_hist_cat = _both(lambda s, d: C.histogram(read(s, d, "events"), "props"))
_scatter = _both(lambda s, d: C.scatter(read(s, d, "documents"), "doc_id", "n_chars", "doc_id", points=None))
_scatter_sample = _both(lambda s, d: C.scatter(read(s, d, "events"), "user_id", "value", "event_id"))
_violin = _both(lambda s, d: C.violin(read(s, d, "events"), "value"))
_pie = _both(lambda s, d: C.pie(read(s, d, "part"), "p_brand"))
_area = _both(lambda s, d: C.area(read(s, d, "events"), "value"))
_area_small = _both(lambda s, d: C.area(read(s, d, "labels"), "doc_id"))
_heat = _both(lambda s, d: C.heatmap(read(s, d, "lineitem"), numbers("lineitem")))
_line = _both(lambda s, d: C.line(read(s, d, "events"), "ts", "value", "event_id"))
_line_numeric = _both(lambda s, d: C.line(read(s, d, "orders"), "o_totalprice", "o_custkey", "o_orderkey"))


def _range_label(x="lo", y="hi"):
    return (f"case when abs({y}) < 1000 then {fx(x, 2)} else {fx(x, 0)} end || ' – ' || case when abs({y}) < 1000 then {fx(y, 2)} else {fx(y, 0)} end")


_STATS = {
    "mean": "avg({c})", "median": "quantile_cont(cast({c} as double), 0.5)", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})",
}


def _stats(rel, c, names, extra=""):
    cols = [f"{r(_STATS[n].format(c=c), 4)} as {n}" for n in names] + [f"{r(skew(c), 4)} as skewness"]
    return f"select {', '.join(cols)}{extra} from {rel}"


def _positions(n: str, k: int, then: str) -> str:
    """Evenly spaced row numbers 0..n-1 (the last one exact), all rows when n <= 500."""
    return (f"case when {n} > 500 then case when i = {k - 1} then {n} - 1 else cast(floor(i * (({n} - 1) / {k - 1}.0)) as bigint) end else i end as {then}")


def _spaced(src: str, k: int) -> str:
    """CTE pos(i, at_row) over the numbered CTE ``src``."""
    return (f"nn as (select count(*) as n from {src}), pos as (select i, n, {_positions('n', k, 'at_row')} from "
            f"(select n, unnest(range(case when n > 500 then {k} else n end)) as i from nn))")


def _area_sql(rel, c):
    return f"""with s as materialized (select cast({c} as double) as v, row_number() over (order by {c}) - 1 as rn from {rel} where {c} is not null), {_spaced('s', 200)}
select i, {r('v', 4)} as value, {r('(i + 1) * 100.0 / (case when n > 500 then 200 else n end)', 2)} as cumulative_pct from pos join s on s.rn = pos.at_row"""


def _percentiles(rel, c):
    return "select " + ", ".join(f"{r(f'quantile_cont(cast({c} as double), {p})', 4)} as p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) + f" from {rel}"


def _line_sql(rel, x, y, order):
    return f"""s as materialized (select {x} as x, {r(y, 4)} as y, row_number() over (order by {order}) - 1 as rn from {rel} where {y} is not null), {_spaced('s', 300)},
o as (select i, x, y from pos join s on s.rn = pos.at_row)"""


def _line_stats(rel, y):
    return f"""select count(*) as points, (select {r(f'avg({y})', 4)} from {rel}) as y_mean,
  case when count(*) > 1 and arg_max(y, i) > arg_min(y, i) then 'increasing' else 'decreasing' end as y_trend from o"""


_LN = numbers("lineitem")
_HEAT_PAIRS = "with a as (select " + ", ".join(f"corr({x}, {y}) as v{i}_{j}" for i, x in enumerate(_LN) for j, y in enumerate(_LN) if i < j) + " from lineitem), h as (" + union(
    [f"select {big(i)} as row_pos, {big(j)} as col_pos, '{x}' as \"row\", '{y}' as col, " + (f"v{min(i, j)}_{max(i, j)}" if i != j else "1.0") + " as value from a"
     for i, x in enumerate(_LN) for j, y in enumerate(_LN)]) + ")"


def _boxplot_sql(rel, cols):
    parts = []
    for c in cols:
        parts.append(f"""select * from (with q as (select quantile_cont(cast({c} as double), 0.25) as q1, quantile_cont(cast({c} as double), 0.5) as q2,
    quantile_cont(cast({c} as double), 0.75) as q3 from {rel}),
  w as (select min(case when {c} >= q1 - 1.5 * (q3 - q1) then {c} end) as lo, max(case when {c} <= q3 + 1.5 * (q3 - q1) then {c} end) as hi from {rel}, q),
  o as (select cast({c} as double) as v, row_number() over (order by {c}) as rn from {rel}, w where {c} < lo or {c} > hi)
  select '{c}' as "column", {r('lo', 4)} as min, {r('q1', 4)} as q1, {r('q2', 4)} as median, {r('q3', 4)} as q3, {r('hi', 4)} as max,
    (select coalesce(string_agg(cast({r('v', 4)} as varchar), '|' order by rn), '') from o where rn <= 50) as outliers, (select count(*) from o) as outlier_count from q, w)""")
    return union(parts)


_SUGGEST = f"""with {S.profile_ctes(JUDGED)},
nu as (select *, row_number() over (partition by dataset_id order by position) as nth from c where type = 'number'),
sv as (select dataset_id, list(name order by nth) as names from nu group by 1),
gp as (select *, row_number() over (partition by dataset_id order by null_count desc, position) as by_gaps from nu where null_count > 0),
al as (
select dataset_id, 'scatter' as chart_type, column1 || '|' || column2 as columns, cast(floor({r('abs(value) * 100', 6)}) as bigint) as priority, 0 as kind, rank as place from r
  where rank <= 3 and abs(value) >= 0.4
union all select dataset_id, 'pie', name, 60, 1, position from c where type = 'string' and unique_count between 2 and 10
union all select dataset_id, 'histogram', name, 40, 2, position from nu where nth <= 3
union all select dataset_id, 'boxplot', array_to_string(names[1:4], '|'), 50, 3, 0 from sv where len(names) >= 2
union all select dataset_id, 'violin', name, 45, 4, 0 from gp where by_gaps = 1
union all select dataset_id, 'heatmap', array_to_string(names[1:8], '|'), 70, 5, 0 from sv where len(names) >= 4),
rk as (select *, row_number() over (partition by dataset_id order by priority desc, kind, place) as ord from al)
select dataset_id, ord, chart_type, columns, priority from rk where ord <= 8"""

QUERIES = {
    "chart_histogram": (_hist[0], f"with {histogram_sql('events', 'value', S.STURGES_30)} select {big('bin')} as bin, {_range_label()} as label, cnt as count from g"),
    "chart_histogram_stats": (_hist[1], f"select q.*, {big('nb')} as bins from ({_stats('events', 'value', ['mean', 'median', 'std', 'min', 'max'])}) q, "
                                        f"(select {S.STURGES_30} as nb from (select count(value) as n from events))"),
    "chart_histogram_density": (_density[0], f"with {histogram_sql('documents', 'n_chars', '20')} select {big('bin')} as bin, {_range_label()} as label, "
                                             f"{r('cnt / cast(n as double) / w', 6)} as density from g"),
    "chart_histogram_categorical": (_hist_cat[0], f"with {top_sql('events', 'props', 25)} select {big('bin')} as bin, substr(value, 1, 30) as label, cnt as count from shown"),
    "chart_histogram_categorical_stats": (_hist_cat[1], f"""with {top_sql('events', 'props', 25)} select count(*) as unique_values, max(case when rn = 1 then value end) as most_common,
      {r('max(cnt) * 100.0 / sum(cnt)', 1)} as most_common_pct from t"""),
    "chart_scatter": (_scatter[0], f"select {r('doc_id', 4)} as x, {r('n_chars', 4)} as y from documents"),
    "chart_scatter_stats": (_scatter[1], f"""select {r('corr(doc_id, n_chars)', 4)} as correlation, count(*) as points, {r('min(doc_id)', 4)} as x_min, {r('max(doc_id)', 4)} as x_max,
      {r('min(n_chars)', 4)} as y_min, {r('max(n_chars)', 4)} as y_max from documents"""),
    "chart_scatter_sample": (_scatter_sample[0], f"select {r('user_id', 4)} as x, {r('value', 4)} as y from (select * from events order by md5('42|' || event_id), user_id, value limit 2000)"),
    "chart_scatter_sample_stats": (_scatter_sample[1], f"""select {r('corr(user_id, value)', 4)} as correlation, count(*) as points, {r('min(user_id)', 4)} as x_min, {r('max(user_id)', 4)} as x_max,
      {r('min(value)', 4)} as y_min, {r('max(value)', 4)} as y_max from (select * from events order by md5('42|' || event_id), user_id, value limit 2000)"""),
    "chart_boxplot": (lambda s, d: tidy(C.boxplot(read(s, d, "events"), ["value", "user_id", "event_type"])), _boxplot_sql("events", ["value", "user_id"])),
    "chart_violin": (_violin[0], f"""with {histogram_sql('events', 'value', '50')}, e as (select *, cnt / cast(n as double) / w as de from g),
      f as (select *, (coalesce(lag(de) over (order by bin), 0.0) + de + coalesce(lead(de) over (order by bin), 0.0)) / 3.0 as s from e), m as (select max(s) as top from f)
      select {big('bin')} as bin, {r('(lo + hi) / 2', 4)} as value, {r('s', 6)} as density, {r('s / (case when top > 0 then top else 1.0 end) * 100', 1)} as density_pct from f, m"""),
    "chart_violin_stats": (_violin[1], _stats("events", "value", ["mean", "median", "std"], f", {r(kurt('value'), 4)} as kurtosis, count(value) as n")),
    "chart_pie": (_pie[0], f"""with {top_sql('part', 'p_brand', 10)} select {big('bin')} as bin, substr(value, 1, 30) as label, cnt as count,
      {r('cnt * 100.0 / sum(cnt) over ()', 1)} as percentage from shown"""),
    "chart_pie_stats": (_pie[1], f"""with {top_sql('part', 'p_brand', 10)} select cast(sum(cnt) as bigint) as total_values, count(*) as unique_categories,
      max(case when rn = 1 then value end) as top_category, {r('max(cnt) * 100.0 / sum(cnt)', 1)} as top_pct from t"""),
    "chart_area": (_area[0], _area_sql("events", "value")),
    "chart_area_stats": (_area[1], _percentiles("events", "value")),
    "chart_area_small": (_area_small[0], _area_sql("labels", "doc_id")),
    "chart_heatmap": (_heat[0], f"{_HEAT_PAIRS} select row_pos, col_pos, \"row\", col, coalesce({r('value', 4)}, 0.0) as value from h"),
    "chart_heatmap_stats": (_heat[1], f"""{_HEAT_PAIRS}, o as (select * from h where row_pos <> col_pos),
      n as (select "row" || ' / ' || col || ' (' || {fx('value', 3)} || ')' as name, row_number() over (order by value desc, row_pos, col_pos) as top,
        row_number() over (order by value, row_pos, col_pos) as low from o)
      select {big(len(_LN))} as size, max(case when top = 1 then name end) as strongest_positive, max(case when low = 1 then name end) as strongest_negative from n"""),
    "chart_line": (_line[0], f"with {_line_sql('events', 'substr(cast(ts as varchar), 1, 20)', 'value', 'event_id')} select * from o"),
    "chart_line_stats": (_line[1], f"with {_line_sql('events', 'substr(cast(ts as varchar), 1, 20)', 'value', 'event_id')} {_line_stats('events', 'value')}"),
    "chart_line_numeric": (_line_numeric[0], f"with {_line_sql('orders', r('o_totalprice', 4), 'o_custkey', 'o_totalprice, o_orderkey')} select * from o"),
    "suggest_charts": (lambda s, d: tidy(C.suggest_charts(J.profiles(s, d))), _SUGGEST),
}
