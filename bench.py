"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; print one JSON line.

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected to the driver) and timed after one warm-up of the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "daily_weather",          # E1 on the hourly grid (events)
    "daily_weather_long",     # E1 on lineitem readings
    "training_table",         # E9: counts -> z filter -> join
    "features_rich",          # E2 + E3 windows / winsorizing
    "scale_standard",         # E6 on the rich features
    "forecast_features",      # E8
    "feature_select",         # E5 pairwise correlations
    "tfidf",                  # M1 over every document's whole text
    "update_subset",          # M5 decision stage
    "stratified_folds",       # M3 sharded ranks
    "regression_metrics",     # A15
    "weighted_vote",          # M12
    "chrono_split",           # W10
    "union_series",           # U1
    "explode_series",         # S4
]


def main() -> None:
    from faultcast.plans.registry import QUERIES
    from faultcast.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", app="faultcast-bench", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})  # local mode: the driver JVM is the only executor
    names = sys.argv[1:] or HEADLINE
    # warm-up: JVM, parquet footers, codegen caches
    QUERIES["daily_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)  # so that a slow key cannot void the others' figures
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
