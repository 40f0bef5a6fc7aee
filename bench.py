"""Benchmark: headline catalog queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (full execution, no
driver collect). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "pack_context",
    "compare_snapshots",
    "change_summary",
    "relevance",
    "stack_trace_files",
    "sync_store",
    "secret_scan",
    "redact",
    "search_topk",
    "segments",
    "trim_history",
    "extension_counts",
    "archive_roundtrip",
    "tree_length",
    "approx_search",
    "build_index",
    "rehydrate_hits",
    "conversation_search",
    "stream_sync",
    "pack_context_diff",
    "context_document",
    "markdown_document",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from quarry.plans.catalog import REGISTRY
    from quarry.session import get_spark

    spark = get_spark()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in REGISTRY]
    # warm-up: JVM, codegen caches, file listing
    REGISTRY["extension_counts"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        REGISTRY[n].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
