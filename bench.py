"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loreloom.catalog import load_all
from loreloom.session import drop_stages, local_session

HEADLINE = (
    "bm25_topk", "alias_contained", "vector_knn", "diversified_topk", "retrieval_eval", "term_stats",
    "exact_dedup", "near_pairs", "greedy_dedup", "sectioned_pages", "chunk_ids", "link_dependencies",
    "redirect_closure", "entity_merge", "corpus_publish", "event_parse", "seq_check", "room_visits",
    "state_rebuild", "stale_results", "throttle", "memory_versions", "memory_recall", "running_budget",
    "percentile_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("loreloom-bench", cores)
    queries = load_all().queries
    names = sys.argv[1:] or [n for n in HEADLINE if n in queries]
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
        drop_stages(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
