"""Time the headline queries and print one JSON line.

Every query runs to completion into a sink that keeps nothing, once to warm up
and then ``BENCH_RUNS`` times; the best time counts. Queries that write or
stream run once.
"""

from __future__ import annotations

import json
import os
import sys
import time
import warnings

from studyloom.plans import catalog
from studyloom.session import local_session

HEADLINE = [
    "learner_levels",
    "win_streak",
    "win_xp_ledger",
    "agg_user_stats",
    "agg_topic_stats",
    "win_revision_recommendations",
    "fn_dashboard_kpis",
    "win_recent_courses",
    "agg_exercise_counters",
    "agg_exercise_progress",
    "agg_exercise_progress_lines",
    "agg_progress_by_difficulty",
    "join_exercise_of_submission",
    "topk_recent_submissions",
    "page_exercises",
    "win_leaderboard",
    "win_final_results",
    "agg_answer_histogram",
    "agg_all_answered",
    "agg_quiz_score",
    "quiz_mistakes",
    "parse_quiz_text",
    "json_repair",
    "extract_code_blocks",
    "extract_headings",
    "code_policy_scan",
    "grade_test_runs",
    "classify_section",
    "chunk_recursive",
    "index_search",
    "knn_topk",
    "rag_context",
    "scan_json_payloads",
    "sort_search_relevance",
]
ONCE = ["stream_participant_totals", "stream_question_barrier", "stream_session_pairing", "stream_xp_ledger"]


def seconds(query, spark, folder) -> float:
    begin = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    warnings.filterwarnings("ignore")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = sys.argv[1:] or HEADLINE + ONCE
    spark = local_session(cpus, cpus)
    known = catalog.queries()
    times = {}
    for name in chosen:
        query = known[name]
        if name in ONCE or name.startswith(("stream_", "sink_", "scan_")):
            times[name] = round(seconds(query, spark, folder), 3)
            continue
        seconds(query, spark, folder)
        times[name] = round(min(seconds(query, spark, folder) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
