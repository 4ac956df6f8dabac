"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line {"metric", "value", "unit", "queries", "sf"}; value is
the sum of per-query medians (each query run $BENCH_RUNS times, default 3,
after one warm-up); a run = build the plan + collect the result.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "split_stratified", "bag_same", "bag_random", "oob_rows", "upsample_shuffle",
    "preprocess_pipeline", "bagging_pipeline", "encode_fixed", "score_all_models",
    "test_summary", "subset_metrics", "loss_ice", "early_stop",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from bagwise.plans.catalog import REGISTRY
    from bagwise.session import get_session
    spark = get_session(f"local[{cpus}]", app="bagwise-bench",
                        shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in HEADLINE if n in REGISTRY]
    if len(sys.argv) > 1:
        names = sys.argv[1:]
    out = {}
    for n in names:
        times = []
        for i in range(runs + 1):
            t = time.time()
            REGISTRY[n](spark, sf_dir).collect()
            if i:
                times.append(time.time() - t)
        out[n] = round(statistics.median(times), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "sf": float(m.group(1)) if m else None}))
    spark.stop()


if __name__ == "__main__":
    main()
