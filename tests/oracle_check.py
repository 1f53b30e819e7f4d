"""Run registered queries against their DuckDB text and report differences.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from tablescope.queries.base import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    return str(v)


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((x is not None, type(x).__name__, x) for x in row))


def compare(df, con, sql: str) -> str:
    """'' when equal, otherwise what differs."""
    names = sorted(df.columns)
    left = [tuple(_plain(row[c]) for c in names) for row in df.collect()]
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} / {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in names]
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    odd = {c: k for c, k in kinds.items() if k.startswith("HUGEINT") or k.startswith("DECIMAL")}
    right = [tuple(_plain(row[i]) for i in at) for row in rel.fetchall()]
    if odd:
        return f"types {odd}"
    for c, k in kinds.items():
        t = df.schema[c].dataType.simpleString()
        pairs = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
        if k in pairs and pairs[k] != t:
            return f"type of {c}: {t} / {k}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    a, b = _sorted(left), _sorted(right)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows, first {names}\n   {bad[0][0]}\n   {bad[0][1]}" if bad else ""


def main() -> int:
    from tablescope.queries import REGISTRY
    from tablescope.session import get_spark

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = get_spark("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                      spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name, (run, sql) in REGISTRY.items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            said = compare(df, con, sql) if sql else f"rows only: {df.count()}"
            ok = not said or not sql
        except Exception as problem:
            said, ok = f"{type(problem).__name__} {str(problem)[:700]}", False
            if len(args) == 1:
                traceback.print_exc()
        bad += not ok
        print("ok  " if ok else "FAIL", name, f"{time.time() - start:.1f}s", said, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
