"""
median of N cold runs (noop sink), rows in (main input tables) and rows out.

Usage: python scripts/baseline_table.py [--sf /root/testdata/sf0.1] [--runs 3] [--cpus 8]
Prints a markdown table.
"""

from __future__ import annotations

import argparse
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Main input tables per query family (rows in = sum of their row counts).
INPUTS = {
    "conversations": ["log_normalise", "merge_short_turns", "session_prompt", "session_rollup", "session_split",
                      "domain_prior", "watchlist_hit", "classify_logs", "governance_flags", "llm_queue",
                      "route_outputs", "run_summary", "chat_assemble", "replay_map", "metric_applicability",
                      "eval_scores", "stream_turn_alerts"],
    "embeddings": ["cosine_topk", "hybrid_scores", "best_category", "score_map", "confidence_route", "label_distribution"],
    "benchmark": ["taxonomy_flatten", "lexical_scores", "classify_logs", "governance_flags", "llm_queue",
                  "route_outputs", "run_summary"],
    "orders": ["governance_matrix", "section_boundaries", "chunk_sections", "section_chunks", "email_headers",
               "thread_findings", "finding_rejects", "thread_report_prompt", "thread_fold", "stream_thread_findings"],
    "lineitem": ["section_boundaries", "chunk_sections", "section_chunks", "module_nodes", "import_edges"],
    "documents": ["lexical_scores", "pages_assemble", "doc_metadata", "chunk_documents", "chunk_prompts",
                  "summary_reduce", "summarise_documents"],
    "pages": ["html_lists", "html_tables", "stopword_filter", "html_text_pages", "page_body_json"],
    "supplier": ["html_tables", "stopword_filter", "html_text_pages", "module_nodes", "import_edges"],
    "customer": ["html_tables", "stopword_filter", "html_text_pages"],
    "part": ["module_nodes", "import_edges"],
}


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--runs", type=int, default=3)
    ap.add_argument("--cpus", default="8")
    a = ap.parse_args()
    from loglens.config import local_session
    from loglens.plans import catalog

    spark = local_session(a.cpus, shuffle_partitions=int(a.cpus) * 2, app="loglens-baseline")
    sizes = {t: spark.read.parquet(f"{a.sf}/{t}.parquet").count() for t in INPUTS}
    catalog.QUERIES["session_rollup"](spark, a.sf).write.format("noop").mode("overwrite").save()
    print(f"Spark {spark.version}, local[{a.cpus}], data {a.sf}\n")
    print("| query | rows in | rows out | seconds (median of %d) | cores | Spark |" % a.runs)
    print("|---|---:|---:|---:|---:|---|")
    for name, fn in catalog.QUERIES.items():
        times = []
        for _ in range(a.runs):
            spark.catalog.clearCache()
            t0 = time.perf_counter()
            fn(spark, a.sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        spark.catalog.clearCache()
        rows_out = fn(spark, a.sf).count()
        rows_in = sum(sizes[t] for t, qs in INPUTS.items() if name in qs)
        print(f"| {name} | {rows_in:,} | {rows_out:,} | {statistics.median(times):.2f} | {a.cpus} | {spark.version} |", flush=True)


if __name__ == "__main__":
    main()
