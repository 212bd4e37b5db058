"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local cores. Every query is
run once unmeasured on the smallest tables beside it, then timed on the whole tables into the no-op sink.
"""

from __future__ import annotations

import json
import os
import re
import time

from lorewell.registry import load
from lorewell.session import build_session

HEADLINE = (
    "search_plan", "search_job", "hybrid_rerank", "vector_topk", "answer_job", "web_index_job", "chunk_text", "hash_embedding",
    "extract_links", "extract_main_text", "classify_page", "classify_upload", "keyword_hits_by_table", "expand_aliases",
    "transfer_intent", "clean_lines", "content_hash", "normalize_url", "validate_rows", "robots_allowed", "frontier",
    "page_budget", "ingested_catalog", "merge_crawl_state", "replace_index", "number_chunks", "pair_turns",
    "bounded_history", "quality_totals", "low_quality_questions", "usage_summary_all", "rate_limit_replay",
    "score_answers", "gates", "usage_per_day", "session_activity",
)


def run(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__ui__showConsoleProgress="false")
    registered, _ = load()
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    seconds = {}
    for name in HEADLINE:
        if os.path.isdir(warm):
            run(registered[name], spark, warm)
        seconds[name] = round(run(registered[name], spark, folder), 3)
    scale = re.search(r"sf([\d.]+)/?$", folder)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
