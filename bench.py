"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query (default 3; the median counts)

All queries run once untimed first, so that the order of the list does not decide
which of them pays for the start of the JVM.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from given_tables.catalog import QUERIES  # noqa: E402
from stayrate.session import build_session  # noqa: E402

HEADLINE = [
    "dataset_profile",
    "price_by_churn",
    "group_means",
    "monthly_price",
    "price_features",
    "price_mom",
    "elasticity",
    "feature_table",
    "histogram50",
    "kde_log",
    "stratified_split",
    "binary_metrics",
    "roc_auc",
    "roc_points",
    "threshold_sweep",
    "segment_rates",
    "at_risk_list",
    "churn_after_rise",
    "churn_by_volatility",
    "oversample",
    "synthetic_minority",
    "rf_predictions",
    "cv_auc",
    "grid_search",
    "permutation_importance",
]
FITS = {"rf_predictions", "cv_auc", "grid_search", "permutation_importance"}


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "stayrate-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        run(spark, name, folder)
    timings = {}
    for name in names:
        repeat = 1 if name in FITS else runs
        timings[name] = round(statistics.median(run(spark, name, folder) for _ in range(repeat)), 3)
        print(f"{name}: {timings[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(os.path.normpath(folder)),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
