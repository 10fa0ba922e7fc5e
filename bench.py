"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs up to three times, or until it has used its time budget; the median counts. The first
run of a query also compiles it, so short queries are judged warm and long ones as they come.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from gleanloom.plans.registry import all_queries
from gleanloom.session import local_session
from gleanloom.sources.tables import read_table

HEADLINE = [
    "extract_content",
    "clean_text",
    "split_sections",
    "recursive_split",
    "chunk_hierarchy",
    "chunk_hierarchy_recursive",
    "embed_texts",
    "keyword_search",
    "vector_search",
    "vector_search_approximate",
    "hybrid_search",
    "merge_chunks",
    "cascade_delete",
    "apply_patches",
    "workspace_list",
    "scan_pages",
    "scope_pages",
    "reachable_pages",
    "parent_context",
    "stream_ingest",
    "stream_status_latest",
    "stream_page_progress",
]
RUNS = 3
BUDGET = 40.0


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    queries, seconds = all_queries(), {}
    for name in HEADLINE:
        spent: list[float] = []
        while len(spent) < RUNS and sum(spent) < BUDGET:
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(spent), 3)
    rows = {t: read_table(spark, folder, t).count() for t in ("documents", "pages", "embeddings", "events")}
    spark.stop()
    rates = {
        "pages_per_sec_extract": round(rows["pages"] / seconds["extract_content"]),
        "documents_per_sec_hierarchy": round(rows["documents"] / seconds["chunk_hierarchy_recursive"]),
        "events_per_sec_status": round(rows["events"] / seconds["stream_status_latest"]),
    }
    line = {
        "metric": "sum of median wall times of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rates": rates,
        "cores": int(cores),
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
