"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from treeledger.plans import QUERIES  # noqa: E402
from treeledger.session import local_session  # noqa: E402

HEADLINE = [
    "mirror_plan", "sync_archive_plan", "enrich_plan", "sync_without_archive", "conflict_copies", "mirror_folders",
    "plan_evidence", "identical_totals", "archive_refresh", "row_rules", "plan_stats", "folder_rollup", "grouped_rows",
    "run_scope", "review_totals", "path_filter", "digest_reuse", "cache_reconcile", "retention_plan", "staggered_removals",
    "latest_run_by_job", "log_lines", "stage_states", "progress_rates", "progress_throttle", "change_batches",
    "raw_event_reduction", "chunk_table", "delta_recipe", "plan_checks", "stream_run_counters",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("treeledger-bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["plan_stats"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
