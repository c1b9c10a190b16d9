"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), and
BENCH_QUERIES: a comma-separated list, or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "group_identity", "grand_identity", "share_policy", "nest_tree", "constant_gate", "measure_pivot", "filing_fact_scan",
    "filer_identity", "duplicate_keys", "name_crosswalk", "dangling_refs", "exact_cover", "edge_symmetry", "canonical_digest",
    "snapshot_diff", "lock_diff", "bill_stack", "prorata_allocation", "schedule_reconcile", "role_cardinality",
    "latest_with_fallback", "topk_remainder", "abs_rank", "interval_union", "rate_distribution", "place_search",
    "citation_audit", "value_binding", "derived_recompute", "scope_asof", "lineage_closure", "sensitive_text",
    "edition_union", "event_dedupe", "ancestor_contains", "coverage_counts", "archive_member_ingest", "release_intake_stream",
]


def main() -> None:
    from tallyroom.plans import QUERIES
    from tallyroom.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("group_identity")  # warm the JVM once
    times = {}
    for name in names:
        times[name] = round(run(name), 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
    }), flush=True)


if __name__ == "__main__":
    main()
