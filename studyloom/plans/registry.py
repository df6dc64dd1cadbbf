"""Registry of named queries.

``<name>`` inside SQL stands for a table of the data folder or for an input
view of :mod:`studyloom.plans.views`.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import VIEWS

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
_NAME = re.compile("<(" + "|".join([*TABLES, *VIEWS]) + ")>")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Result columns widened to 64 bits, as the checking engine gives them.
WIDE = {
    "learner_levels": "current_streak longest_streak level",
    "win_streak": "streak",
    "win_streak_before": "streak streak_before",
    "win_xp_ledger": "streak streak_before old_level new_level",
    "stream_xp_ledger": "streak streak_before old_level new_level",
    "fn_level": "level",
    "fn_level_title": "level",
    "scan_content_index": "section_pos file_pos",
    "chunk_threshold": "first_length",
    "knn_topk": "rank",
    "topk_knn": "rank",
    "knn_every_vector": "rank",
    "agg_tests_passed": "passed_tests total_tests",
    "topk_recent_progress": "position",
    "topk_recent_submissions": "position",
    "topk_recent_submissions_detail": "position",
    "agg_weak_topics": "position",
    "win_recent_mistakes": "position",
    "win_revision_recommendations": "position",
    "win_recent_courses": "place",
    "union_padding_subjects": "place",
    "extract_code_blocks": "position",
    "extract_code_blocks_chat": "position",
    "extract_headings": "position level",
    "extract_list_items": "position",
    "extract_list_items_chat": "position",
    "extract_md_tables": "position row_number",
    "parse_quiz_text": "question_number correct_answer",
    "quiz_fallback": "question_number correct_answer",
    "fn_letter_index": "n position",
    "agg_quiz_score": "correct_answers",
    "fn_answer_text": "i",
}


def _widened(fn, columns: list[str]):
    @functools.wraps(fn)
    def run(spark, folder):
        rows = fn(spark, folder)
        return rows.withColumns({c: F.col(c).cast("long") for c in columns})

    return run


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can state it, the SQL that checks it."""

    def keep(fn):
        QUERIES[name] = _widened(fn, WIDE[name].split()) if name in WIDE else fn
        if sql is not None:
            ORACLES[name] = expand(sql, lambda table: table)
        return fn

    return keep


def expand(sql: str, table_name: Callable[[str], str]) -> str:
    """Replace every ``<name>`` by a table name or a parenthesised view."""

    def one(match):
        name = match.group(1)
        return f"({expand(VIEWS[name], table_name)})" if name in VIEWS else table_name(name)

    return _NAME.sub(one, sql)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An input view as a DataFrame; the scan stays a plain Parquet scan."""
    return spark.sql(expand(VIEWS[name], lambda table: f"parquet.`{folder}/{table}.parquet`"))
