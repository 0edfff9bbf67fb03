"""Time the headline queries: one JSON line on stdout, progress on stderr.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores) and BENCH_QUERIES
(comma-separated names, or "all") choose what runs. Every query is executed once in full
into Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from relearn import catalog
from relearn.session import local_session

HEADLINE = [
    "a3_audit_all", "a4_parse_vision", "a6_merge_changes", "a7_batched_due",
    "b2_list_questions", "b5_review_queue", "b7_profile_stats", "b9_sheet_history", "b11_sheet_review",
    "c2_answer_coverage", "c4_attempt_summary", "c5_number_attempts", "c6_dedup_attempts", "c9_apply_wrong_count",
    "c11_mastery_state", "c13_question_history", "c14_reconcile_updates",
    "d2_validate_items", "d4_validate_localizations", "d9_red_evidence", "d11_ocr_verdict", "d12_collection_decision",
    "d14_drop_duplicate_candidates", "d17_recognition_images",
    "e1_selection_verdicts", "e4_derivative_verdicts", "e5_expand_sheet_items",
    "f2_purge_questions", "f4_review_outcome", "f10_purge_accounts", "g6_resolve_phone_bindings",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES", "")
    queries = catalog.queries()
    names = list(queries) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()  # start the executors before timing
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )


if __name__ == "__main__":
    main()
