"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the cores.  Each query runs
once to warm up and then BENCH_RUNS times (3); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from loci.plans import catalog
from loci.session import build_session

HEADLINE = (
    "topk_cosine", "batch_topk_per_query", "check_duplicates", "exact_duplicates", "palace_rank", "audit_decisions",
    "status_grouping_sets", "recall_rooms", "l1_char_budget", "diary_recent", "store_current", "kg_dedup_open_triples",
    "kg_asof", "kg_timeline", "kg_stats", "kg_reconcile_action", "tunnels_all", "bfs_hops", "taxonomy_tree_paths",
    "chunk_text", "chunk_exchanges", "message_pairing", "marker_counts", "entity_candidates", "temporal_info",
    "segments", "normalize_text", "token_f1", "chat_parsers", "text_search_best",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    catalog.load_all()
    spark = build_session(
        "loci-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for i in range(runs + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times), 3)
    n = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    out = {
        "metric": "total seconds of the headline queries (median of warm runs)", "value": round(sum(took.values()), 3),
        "unit": "sec", "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "batch_topk_queries_per_sec": round(n / took["batch_topk_per_query"], 1),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
