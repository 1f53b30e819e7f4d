"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

from tablescope.queries import REGISTRY
from tablescope.queries.base import table
from tablescope.operators.profile import profile
from tablescope.plans.analyze import analyze
from tablescope.session import get_spark


def _analyze(spark, sf_dir):
    a = analyze({"lineitem": table(spark, sf_dir, "lineitem")})
    return a.next_steps


def _profile(spark, sf_dir):
    return profile(table(spark, sf_dir, "lineitem"), "lineitem").columns


# Full analysis and profile of the largest table, then one query per operator family.
HEADLINES = {
    "analyze_lineitem": _analyze,
    "profile_lineitem": _profile,
    **{name: REGISTRY[name][0] for name in (
        "duplicate_pct", "column_profile", "value_ranks", "exact_quantiles", "pair_correlations", "numeric_distributions", "bias_figures",
        "missing_median", "missing_mode", "missing_iterative", "missing_smart_dirty", "remove_duplicates", "scale_robust", "outliers_iqr", "encode_label",
        "skew_yeojohnson", "prep_steps", "smote", "bootstrap_noise", "chart_histogram", "chart_area", "chart_heatmap", "chart_boxplot",
        "search", "similarity_topk", "search_semantic", "read_csv_resilient", "baseline_model", "missing_knn_customer", "similarity_topk_batch",
        "missing_iterative_single", "stratified_split", "read_csv_multiline")},
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = get_spark("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(cpus), spark__ui__enabled="false",
                      spark__ui__showConsoleProgress="false", spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"), spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    table(spark, sf_dir, "nation").count()      # session start is not part of any query
    only = sys.argv[1:]
    seconds: dict[str, float] = {}
    for name, run in HEADLINES.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": float(sf.group(1).rstrip(".")) if sf else None}))


if __name__ == "__main__":
    main()
