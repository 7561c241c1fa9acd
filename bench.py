"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import time

from lexweave.queries import load
from lexweave.session import local_session

#: What an index of documents is for: build it, search it by both channels, and the stages around it.
HEADLINE = ["bm25_index", "term_stats", "bm25_topk", "dense_topk", "hybrid_topk", "norm_text", "tokenize", "headings_found", "section_path", "chunks", "chunk_split", "catalog_build", "match_query", "context_budget", "event_fold", "set_rating", "cascade_delete", "intent"]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "12g", **{"spark.ui.showConsoleProgress": "false"})
    took: dict[str, float] = {}
    queries = load()
    queries["intent"][0](spark, d).write.format("noop").mode("overwrite").save()  # start workers and compile once
    for name in HEADLINE:
        spark.catalog.clearCache()
        began = time.time()
        queries[name][0](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
