"""Time the headline queries: one JSON line, seconds per query, one cold run each."""
from __future__ import annotations

import json
import os
import sys
import time

from statuta import plans
from statuta.session import local_session

HEADLINE = [
    "term_stats", "bm25_topk", "tfidf_topk", "dense_topk", "rrf_merge", "hybrid_search", "query_dedup_batch", "hard_negatives",
    "hierarchy_parse", "hierarchy_parse_v2", "chunk_leaf", "chunk_enrich_dedup", "token_windows",
    "cascade_enrich", "phrase_scan_join", "citation_match", "citation_prf", "citation_extract",
    "corpus_audit", "score_percentiles", "score_percentile_rank", "trailing_request_count",
    "gate_profiles", "diversify", "recall_mrr", "version_comparison", "store_commit", "incremental_ingest_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "16g")
    queries, _ = plans.load()
    spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(length(text))").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]:.2f}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
