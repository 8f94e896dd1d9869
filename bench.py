"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tieout.queries import QUERIES
from tieout.session import build_session

HEADLINE = [
    "round_net", "text_amount", "serial_shipdate", "sumifs_supplier", "vlookup_first_order", "asof_purchase",
    "running_total_user", "prior_event", "pivot_status", "aggregate_functions", "percentile_functions", "dup_keys",
    "allocate_tax", "allocate_total", "profile_orders", "profile_lineitem", "contract_orders", "verify_net_amounts",
    "verify_summary", "compare_ordered", "reconcile_regions", "event_runs", "run_breaks", "overlapping_shipments",
    "trade_levels", "search_docs", "mask_docs", "latest_per_step", "adjustment",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", "bench", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds, jobs, failed = {}, {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        try:
            spark.sparkContext.setJobGroup(name, name)
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
            jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        except Exception as error:  # one failure leaves the other figures
            failed[name] = str(error)[:200]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "jobs": jobs, "failed": failed}))
    spark.stop()


if __name__ == "__main__":
    main()
