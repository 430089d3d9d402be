"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.
Each query is built and fully executed (``noop`` write, so every row and
column is computed without collecting to the driver); the reported time is
the median of $BENCH_RUNS runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "job_1_collection_run": "job_1",
    "job_3_dry_run": "job_3",
    "job_4_discovery": "job_4",
    "job_5_run_diff": "job_5",
    "job_2_second_pass": "job_2_details",
    "job_2_from_pages": "job_2",
    "udf_1_pages_markdown": "udf_1",
    "nrm_all_payloads": "all_payloads",
    "nrm_20_generic_links": "nrm_20",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from gleaner import catalog
    from gleaner.session import get_spark
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="gleaner-bench")
    times: dict[str, float] = {}
    for label, name in HEADLINE.items():
        fn = catalog.QUERIES.get(name) or getattr(catalog, name)
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                samples.append(dt)
        times[label] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "median_wall_time_sum", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
