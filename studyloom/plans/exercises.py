"""Exercise catalogue, submissions and progress."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import exercises as ops
from .registry import query, table, view

_CARD = ["id", "title", "description", "difficulty", "topic"]
_CARD_SQL = "id, title, description, difficulty, topic"


@query(
    "filter_exercise_catalog",
    f"""SELECT {_CARD_SQL} FROM <fx_exercises> e WHERE is_active AND difficulty = 'beginner' AND contains(lower(topic), 'econ')
    AND (contains(lower(title), 'brand#1') OR contains(lower(description), 'brand#1'))""",
)
def filter_exercise_catalog(spark, folder):
    found = ops.exercise_catalog(view(spark, folder, "fx_exercises"), "beginner", "EcoN", "BRAND#1")
    return found.select(*_CARD)


@query("agg_distinct_topics", "SELECT DISTINCT topic FROM <fx_exercises> e WHERE is_active")
def agg_distinct_topics(spark, folder):
    return ops.topics(view(spark, folder, "fx_exercises"))


_PAGES = f"""WITH numbered AS (SELECT {_CARD_SQL}, row_number() OVER (ORDER BY created_at DESC, id) AS position,
  count(*) OVER () AS total FROM <fx_exercises> e WHERE is_active)"""


@query(
    "page_exercises", f"{_PAGES} SELECT {_CARD_SQL}, position FROM numbered WHERE position > 24 AND position <= 36"
)
def page_exercises(spark, folder):
    rows = ops.page(ops.exercise_catalog(view(spark, folder, "fx_exercises")), "3")
    return rows.select(*_CARD, "position")


@query(
    "page_exercises_last",
    f"{_PAGES} SELECT {_CARD_SQL}, position FROM numbered WHERE position > (CAST(ceil(total / 12) AS BIGINT) - 1) * 12",
)
def page_exercises_last(spark, folder):
    rows = ops.page(ops.exercise_catalog(view(spark, folder, "fx_exercises")), "999999999")
    return rows.select(*_CARD, "position")


@query(
    "join_progress_on_page",
    f"""{_PAGES} SELECT n.id, title, position, is_completed, attempts_count FROM numbered n
    LEFT JOIN (SELECT * FROM <fx_progress> p WHERE user_id = 7) p ON p.exercise_id = n.id WHERE position <= 12""",
)
def join_progress_on_page(spark, folder):
    first = ops.page(ops.exercise_catalog(view(spark, folder, "fx_exercises")), "one")
    return ops.with_progress(first, view(spark, folder, "fx_progress"), 7).select(
        "id", "title", "position", "is_completed", "attempts_count"
    )


@query(
    "join_exercise_of_progress",
    """SELECT p.user_id, p.exercise_id, p.is_completed, e.title, e.difficulty, e.topic
    FROM <fx_progress> p JOIN <fx_exercises> e ON e.id = p.exercise_id""",
)
def join_exercise_of_progress(spark, folder):
    joined = ops.with_exercise(view(spark, folder, "fx_progress"), view(spark, folder, "fx_exercises"))
    return joined.select("user_id", "exercise_id", "is_completed", "title", "difficulty", "topic")


@query(
    "join_exercise_of_submission",
    """SELECT s.exercise_id, s.user_id, s.status, e.title, e.difficulty FROM <fx_submissions> s JOIN <fx_exercises> e ON e.id = s.exercise_id""",
)
def join_exercise_of_submission(spark, folder):
    joined = ops.with_exercise(view(spark, folder, "fx_submissions"), view(spark, folder, "fx_exercises"))
    return joined.select("exercise_id", "user_id", "status", "title", "difficulty")


@query(
    "join_progress_difficulty",
    """SELECT p.user_id, p.exercise_id, p.is_completed FROM <fx_progress> p JOIN <fx_exercises> e ON e.id = p.exercise_id WHERE e.difficulty = 'advanced'""",
)
def join_progress_difficulty(spark, folder):
    rows = ops.progress_of(view(spark, folder, "fx_progress"), view(spark, folder, "fx_exercises"), "advanced")
    return rows.select("user_id", "exercise_id", "is_completed")


@query(
    "filter_admin_search",
    f"""SELECT {_CARD_SQL} FROM <fx_exercises> e
    WHERE (contains(lower(title), 'ring') OR contains(lower(description), 'ring') OR contains(lower(topic), 'ring'))
      AND (contains(lower(title), 'small') OR contains(lower(description), 'small') OR contains(lower(topic), 'small'))
      AND is_active AND created_at >= DATE '2024-03-01'""",
)
def filter_admin_search(spark, folder):
    rows = ops.admin_search(
        view(spark, folder, "fx_exercises"),
        "Ring SMALL",
        ["title", "description", "topic"],
        {"is_active": True},
        ("created_at", "2024-03-01"),
    )
    return rows.select(*_CARD)


@query(
    "filter_admin_progress",
    """SELECT p.id, u.username, e.title, p.is_completed FROM <fx_progress> p JOIN <fx_users> u ON u.id = p.user_id JOIN <fx_exercises> e ON e.id = p.exercise_id
    WHERE (contains(lower(u.username), '7') OR contains(lower(e.title), '7')) AND (contains(lower(u.username), 'o') OR contains(lower(e.title), 'o'))
      AND p.is_completed AND e.difficulty = 'advanced' AND p.first_attempt_at >= DATE '1995-01-01' AND p.first_attempt_at < DATE '1996-01-01'""",
)
def filter_admin_progress(spark, folder):
    """Progress searched by user name and exercise title, with the three filters of its list."""
    users = view(spark, folder, "fx_users").select(F.col("id").alias("user_id"), "username")
    cards = view(spark, folder, "fx_exercises").select(F.col("id").alias("exercise_id"), "title", "difficulty")
    rows = view(spark, folder, "fx_progress").join(users, "user_id").join(cards, "exercise_id")
    found = ops.admin_search(
        rows, "7 O", ["username", "title"], {"is_completed": True, "difficulty": "advanced"}, bucket=("first_attempt_at", "year", "1995-06-01")
    )
    return found.select("id", "username", "title", "is_completed")


_BUCKETS = {
    "today": ("2024-03-05", "2024-03-06"), "7 days": ("2024-02-27", "2024-03-06"), "month": ("2024-03-01", "2024-04-01"), "year": ("2024-01-01", "2025-01-01"),
}


@query(
    "filter_admin_buckets",
    " UNION ALL ".join(
        f"SELECT '{name}' AS bucket, id, title FROM <fx_exercises> e WHERE is_active AND created_at >= DATE '{low}' AND created_at < DATE '{high}'"
        for name, (low, high) in _BUCKETS.items()
    ),
)
def filter_admin_buckets(spark, folder):
    """What the four date filters of the admin list show on 2024-03-05."""
    rows = view(spark, folder, "fx_exercises")
    shown = [
        ops.admin_search(rows, "", [], {"is_active": True}, bucket=("created_at", name, "2024-03-05"))
        .select(F.lit(name).alias("bucket"), "id", "title")
        for name in _BUCKETS
    ]
    return functools.reduce(DataFrame.union, shown)


@query(
    "filter_admin_search_joined",
    """SELECT s.id, u.username, e.title, s.status FROM <fx_attempts> s JOIN <fx_exercises> e ON e.id = s.exercise_id JOIN <fx_users> u ON u.id = s.user_id
    WHERE s.status = 'failed' AND e.difficulty = 'beginner' AND (contains(lower(u.username), '00012') OR contains(lower(e.title), '00012'))
      AND (contains(lower(u.username), 'o') OR contains(lower(e.title), 'o'))""",
)
def filter_admin_search_joined(spark, folder):
    users = view(spark, folder, "fx_users").select(F.col("id").alias("user_id"), "username")
    rows = ops.with_exercise(view(spark, folder, "fx_attempts"), view(spark, folder, "fx_exercises")).join(
        users, "user_id"
    )
    found = ops.admin_search(
        rows, "00012 O", ["username", "title"], {"status": "failed", "difficulty": "beginner"}
    )
    return found.select("id", "username", "title", "status")


_COUNTERS = """SELECT exercise_id, count(*) FILTER (WHERE status IN ('success', 'failed')) AS attempts_count,
  count(*) FILTER (WHERE status = 'success') AS success_count FROM <fx_submissions> s GROUP BY exercise_id"""


@query("agg_exercise_counters", _COUNTERS)
def agg_exercise_counters(spark, folder):
    return ops.exercise_counters(view(spark, folder, "fx_submissions"))


@query(
    "agg_success_rate",
    f"""SELECT exercise_id, attempts_count, success_count,
    CASE WHEN attempts_count = 0 THEN 0 ELSE round_even(success_count / attempts_count * 100, 1) END AS success_rate FROM ({_COUNTERS}) c""",
)
def agg_success_rate(spark, folder):
    rate = ops.success_rate(F.col("attempts_count"), F.col("success_count"))
    return ops.exercise_counters(view(spark, folder, "fx_submissions")).withColumn("success_rate", rate)


def _progress_sql(source, best_id):
    return f"""SELECT user_id, exercise_id, count(*) AS attempts_count, bool_or(status = 'success') AS is_completed,
    min(submitted_at) FILTER (WHERE status = 'success') AS completed_at,
    min_by({best_id}, row(execution_time, submitted_at, {best_id})) FILTER (WHERE status = 'success') AS best_submission,
    min(execution_time) FILTER (WHERE status = 'success') AS best_time
    FROM {source} s WHERE status IN ('success', 'failed') GROUP BY user_id, exercise_id"""


@query("agg_exercise_progress", _progress_sql("<fx_attempts>", "id"))
def agg_exercise_progress(spark, folder):
    return ops.progress(view(spark, folder, "fx_attempts"))


@query(
    "agg_exercise_progress_lines",
    """SELECT user_id, exercise_id, count(*) AS attempts_count, bool_or(status = 'success') AS is_completed,
    min(submitted_at) FILTER (WHERE status = 'success') AS completed_at,
    min(execution_time) FILTER (WHERE status = 'success') AS best_time
    FROM <fx_submissions> s WHERE status IN ('success', 'failed') GROUP BY user_id, exercise_id""",
)
def agg_exercise_progress_lines(spark, folder):
    lines = view(spark, folder, "fx_submissions").withColumn("id", F.lit(0))
    return ops.progress(lines).drop("best_submission")


def _test_results():
    return F.transform(
        F.sequence(F.lit(1), (F.col("o_orderkey") % 4).cast("int") + 1),
        lambda i: F.struct(
            i.alias("test_number"),
            ((F.col("o_orderkey") + i) % 3 != 0).alias("passed"),
            F.when((F.col("o_orderkey") + i) % 3 != 0, "")
            .otherwise(F.concat(F.lit("test "), i.cast("string"), F.lit(" failed")))
            .alias("error"),
        ),
    )


_TESTS = """WITH t AS (SELECT o_orderkey AS id, i, (o_orderkey + i) % 3 <> 0 AS passed FROM orders, unnest(range(1, CAST(o_orderkey % 4 AS INT) + 2)) u(i)),
totals AS (SELECT id, count(*) FILTER (WHERE passed) AS passed_tests, count(*) AS total_tests,
  coalesce(string_agg(concat('test ', i, ' failed'), chr(10) ORDER BY i) FILTER (WHERE NOT passed), '') AS error_message FROM t GROUP BY id)"""


@query(
    "agg_tests_passed",
    f"{_TESTS} SELECT id, passed_tests, total_tests, CASE WHEN passed_tests = total_tests THEN 'success' ELSE 'failed' END AS status FROM totals",
)
def agg_tests_passed(spark, folder):
    subs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), _test_results().alias("test_results"))
    return ops.test_totals(subs).drop("error_message")


@query("agg_error_summary", f"{_TESTS} SELECT id, error_message FROM totals")
def agg_error_summary(spark, folder):
    subs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), _test_results().alias("test_results"))
    return ops.test_totals(subs).select("id", "error_message")


@query(
    "agg_progress_by_difficulty",
    """WITH totals AS (SELECT difficulty, count(*) AS total FROM <fx_exercises> e WHERE is_active GROUP BY difficulty),
    done AS (SELECT p.user_id, e.difficulty, count(*) AS completed, count(*) FILTER (WHERE e.is_active) AS completed_active
      FROM <fx_progress> p JOIN <fx_exercises> e ON e.id = p.exercise_id WHERE p.is_completed GROUP BY p.user_id, e.difficulty),
    grid AS (SELECT u.id AS user_id, d.difficulty FROM <fx_users> u CROSS JOIN (VALUES ('beginner'), ('intermediate'), ('advanced')) d(difficulty))
    SELECT g.user_id, g.difficulty, coalesce(total, 0) AS total, coalesce(completed, 0) AS completed, coalesce(completed_active, 0) AS completed_active,
      CASE WHEN coalesce(total, 0) = 0 THEN 0 ELSE round_even(coalesce(completed, 0) / total * 100, 1) END AS percentage
    FROM grid g LEFT JOIN totals t ON t.difficulty = g.difficulty LEFT JOIN done d ON d.user_id = g.user_id AND d.difficulty = g.difficulty""",
)
def agg_progress_by_difficulty(spark, folder):
    return ops.progress_by_difficulty(
        view(spark, folder, "fx_exercises"), view(spark, folder, "fx_progress"), view(spark, folder, "fx_users")
    )


@query(
    "agg_overall_completion",
    """WITH t AS (SELECT count(*) AS total FROM <fx_exercises> e WHERE is_active)
    SELECT user_id, count(*) FILTER (WHERE is_completed) AS completed, total, round_even(count(*) FILTER (WHERE is_completed) / total * 100, 1) AS percentage
    FROM <fx_progress> p CROSS JOIN t GROUP BY user_id, total""",
)
def agg_overall_completion(spark, folder):
    return ops.completion(view(spark, folder, "fx_exercises"), view(spark, folder, "fx_progress"))


@query(
    "topk_recent_progress",
    """SELECT * FROM (SELECT user_id, exercise_id, first_attempt_at, row_number() OVER (PARTITION BY user_id ORDER BY first_attempt_at DESC, id DESC) AS position
    FROM <fx_progress> p) t WHERE position <= 10""",
)
def topk_recent_progress(spark, folder):
    return ops.recent_progress(view(spark, folder, "fx_progress")).select(
        "user_id", "exercise_id", "first_attempt_at", "position"
    )


@query(
    "topk_recent_submissions",
    """SELECT * FROM (SELECT id, user_id, exercise_id, status, row_number() OVER (PARTITION BY user_id ORDER BY submitted_at DESC, id DESC) AS position
    FROM <fx_attempts> a) t WHERE position <= 10""",
)
def topk_recent_submissions(spark, folder):
    return ops.recent_submissions(view(spark, folder, "fx_attempts")).select(
        "id", "user_id", "exercise_id", "status", "position"
    )


@query(
    "topk_recent_submissions_detail",
    """SELECT * FROM (SELECT id, user_id, exercise_id, status, row_number() OVER (PARTITION BY user_id, exercise_id ORDER BY submitted_at DESC, id DESC) AS position
    FROM <fx_attempts> a) t WHERE position <= 2""",
)
def topk_recent_submissions_detail(spark, folder):
    rows = ops.recent_submissions(view(spark, folder, "fx_attempts"), ("user_id", "exercise_id"), 2)
    return rows.select("id", "user_id", "exercise_id", "status", "position")


@query(
    "win_first_attempt",
    """SELECT user_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS exercise_id, min(ts) AS first_attempt_at
    FROM events WHERE event_type = 'view' GROUP BY ALL""",
)
def win_first_attempt(spark, folder):
    views = (
        table(spark, folder, "events")
        .where("event_type = 'view'")
        .select("user_id", F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("exercise_id"), "ts")
    )
    return ops.first_attempt(views)
