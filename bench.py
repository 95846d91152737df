"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables (default /root/testdata/sf0.1), BENCH_CPUS the
local cores. Every query runs whole into a no-op sink; its value is the best of
BENCH_RUNS runs (default 3), so that the figure is not one of class loading.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tallybook import build_session
from workload.queries import QUERIES

HEADLINE = ("q_reconcile_batch_summary", "q_reconcile_items", "q_reconcile_lineitem",
            "q_dup_first", "q_dup_first_lineitem", "q_settled_lookup", "q_reference_amount",
            "q_uid_clean", "q_amount_parse", "q_round_half_up", "q_import_rows", "q_ledger_totals",
            "q_header_detect", "q_mapping_apply", "q_processed_files", "q_apply_once",
            "q_csv_inbox", "q_workbook_inbox")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))
                      .removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
