"""Exercise catalogue, submissions and per-learner progress.

``exercises``: id, title, description, difficulty, topic, is_active,
created_by, created_at. ``submissions``: id, exercise_id, user_id, status,
execution_time, submitted_at. ``progress``: user_id, exercise_id,
is_completed, attempts_count, first_attempt_at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_folded
from .ordered import first_n, positions

DIFFICULTIES = ["beginner", "intermediate", "advanced"]
GRADED = ["success", "failed"]
PAGE_SIZE = 12
RECENT_ROWS = 10


def exercise_catalog(exercises: DataFrame, difficulty: str = "", topic: str = "", search: str = "") -> DataFrame:
    """Active exercises; every filter applies only when it is not empty."""
    found = exercises.where("is_active")
    if difficulty:
        found = found.where(F.col("difficulty") == difficulty)
    if topic:
        found = found.where(contains_folded(F.col("topic"), topic))
    if search:
        found = found.where(
            contains_folded(F.col("title"), search) | contains_folded(F.col("description"), search)
        )
    return found


def topics(exercises: DataFrame) -> DataFrame:
    return exercises.where("is_active").select("topic").distinct()


def page(exercises: DataFrame, number: str | int | None, size: int = PAGE_SIZE) -> DataFrame:
    """One page of the catalogue, newest first, with each row's position.

    Anything that is not a whole number gives page 1; a number outside the
    pages gives the last one. Ids are numbered in slices of one creation minute
    each, so no task sorts the whole catalogue; the full rows are fetched for
    the page alone.
    """
    try:
        wanted = int(number)
    except (TypeError, ValueError):
        wanted = 1
    total = exercises.agg(F.count("*")).scalar()
    last = F.greatest(F.lit(1), F.ceil(total / size))
    shown = F.when(F.lit(wanted).between(F.lit(1), last), F.lit(wanted)).otherwise(last)
    ids = exercises.select("id", "created_at", F.date_trunc("minute", "created_at").alias("minute"))
    numbered = positions(ids, [], [("minute", True)], [F.col("created_at").desc(), F.col("id")])
    on_page = numbered.where(
        (F.col("position") > (shown - 1) * size) & (F.col("position") <= shown * size)
    ).select("id", "position")
    # A page holds ``size`` ids, so it may be sent to every task.
    return exercises.join(F.broadcast(on_page), "id")


def with_progress(page_rows: DataFrame, progress: DataFrame, user_id: int) -> DataFrame:
    """A page of exercises with one learner's progress, where there is any."""
    own = progress.where(F.col("user_id") == user_id).select(
        F.col("exercise_id").alias("id"), "is_completed", "attempts_count"
    )
    return page_rows.join(own, "id", "left")


def with_exercise(rows: DataFrame, exercises: DataFrame) -> DataFrame:
    """Progress or submission rows with title, difficulty and topic of the exercise."""
    details = exercises.select(F.col("id").alias("exercise_id"), "title", "difficulty", "topic")
    return rows.join(details, "exercise_id")


def progress_of(progress: DataFrame, exercises: DataFrame, difficulty: str) -> DataFrame:
    """Progress on exercises of one difficulty."""
    wanted = exercises.where(F.col("difficulty") == difficulty).select(F.col("id").alias("exercise_id"))
    return progress.join(wanted, "exercise_id", "left_semi")


def in_bucket(at: Column, bucket: str, day: str) -> Column:
    """Whether a time falls "today", in the past "7 days", in this "month" or "year", as seen on an ISO day.

    Each bucket is a half-open range of dates; one of days ends with that day.
    """
    today = F.to_date(F.lit(day))
    low, high = {
        "today": (today, F.date_add(today, 1)),
        "7 days": (F.date_sub(today, 7), F.date_add(today, 1)),
        "month": (F.to_date(F.trunc(today, "month")), F.add_months(F.trunc(today, "month"), 1)),
        "year": (F.to_date(F.trunc(today, "year")), F.add_months(F.trunc(today, "year"), 12)),
    }[bucket]
    return (at >= low) & (at < high)


def admin_search(
    rows: DataFrame,
    text: str,
    columns: Sequence[str],
    filters: Mapping[str, object] | None = None,
    since: tuple[str, str] | None = None,
    bucket: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Rows where each word of ``text`` occurs in some column, with equality filters.

    ``since`` = (column, ISO date) keeps rows of that day or later; ``bucket``
    = (column, bucket, ISO date) those of a date bucket (``in_bucket``).
    """
    for term in text.split():
        hit: Column = F.lit(False)
        for name in columns:
            hit = hit | F.coalesce(contains_folded(F.col(name), term), F.lit(False))
        rows = rows.where(hit)
    for name, value in (filters or {}).items():
        rows = rows.where(F.col(name) == F.lit(value))
    if since:
        rows = rows.where(F.to_date(since[0]) >= F.to_date(F.lit(since[1])))
    if bucket:
        rows = rows.where(in_bucket(F.col(bucket[0]), *bucket[1:]))
    return rows


def exercise_counters(submissions: DataFrame) -> DataFrame:
    """Graded submissions and successes per exercise."""
    return submissions.groupBy("exercise_id").agg(
        F.count_if(F.col("status").isin(GRADED)).alias("attempts_count"),
        F.count_if(F.col("status") == "success").alias("success_count"),
    )


def success_rate(attempts: Column, successes: Column) -> Column:
    """Successes per hundred attempts to one place, ties to even; 0 without attempts."""
    return F.when(attempts == 0, F.lit(0.0)).otherwise(
        F.bround(successes / F.nullif(attempts, F.lit(0)) * 100, 1)
    )


def progress(submissions: DataFrame) -> DataFrame:
    """Progress per (user, exercise) from the submission log.

    The best submission is the fastest success, the earliest of equally fast
    ones.
    """
    keys = ["user_id", "exercise_id"]
    success = F.col("status") == "success"
    counts = (
        submissions.where(F.col("status").isin(GRADED))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("attempts_count"),
            F.bool_or(success).alias("is_completed"),
            F.min(F.when(success, F.col("submitted_at"))).alias("completed_at"),
        )
    )
    # Ordered among successes only; the counts stay in a hash aggregate.
    best = first_n(submissions.where(success), keys, [F.col(c) for c in ("execution_time", "submitted_at", "id")], 1)
    return counts.join(best.select(*keys, F.col("id").alias("best_submission"), F.col("execution_time").alias("best_time")), keys, "left")


def test_totals(submissions: DataFrame) -> DataFrame:
    """Passed and total tests per submission, and the summary of errors."""
    passed = F.size(F.filter("test_results", lambda t: t["passed"]))
    total = F.size("test_results")
    errors = F.filter(F.transform("test_results", lambda t: t["error"]), lambda e: e != "")
    return submissions.select(
        "id",
        passed.alias("passed_tests"),
        total.alias("total_tests"),
        F.when(total == 0, "pending").when(passed == total, "success").otherwise("failed").alias("status"),
        F.when(passed < total, F.array_join(errors, "\n")).otherwise("").alias("error_message"),
    )


def progress_by_difficulty(exercises: DataFrame, progress_rows: DataFrame, users: DataFrame) -> DataFrame:
    """Per user and difficulty: active exercises, completed ones, percentage.

    Completed counts progress on inactive exercises too, so the percentage can
    pass 100; ``completed_active`` leaves those out.
    """
    # One row per known difficulty: three rows to broadcast.
    totals = (
        exercises.where(F.col("is_active") & F.col("difficulty").isin(DIFFICULTIES))
        .groupBy("difficulty")
        .agg(F.count("*").alias("total"))
    )
    done = (
        progress_rows.where("is_completed")
        .join(
            exercises.select(F.col("id").alias("exercise_id"), "difficulty", "is_active"), "exercise_id"
        )
        .groupBy("user_id", "difficulty")
        .agg(F.count("*").alias("completed"), F.count_if("is_active").alias("completed_active"))
    )
    levels = F.explode(F.array(*[F.lit(d) for d in DIFFICULTIES])).alias("difficulty")
    zero = F.lit(0).cast("long")
    filled = (
        users.select(F.col("id").alias("user_id"), levels)
        .join(F.broadcast(totals), "difficulty", "left")
        .join(done, ["user_id", "difficulty"], "left")
        .select(
            "user_id",
            "difficulty",
            *[F.coalesce(c, zero).alias(c) for c in ("total", "completed", "completed_active")],
        )
    )
    return filled.withColumn("percentage", success_rate(F.col("total"), F.col("completed")))


def completion(exercises: DataFrame, progress_rows: DataFrame) -> DataFrame:
    """Completed exercises per user against all active ones."""
    total = exercises.where("is_active").agg(F.count("*")).scalar()
    return (
        progress_rows.groupBy("user_id")
        .agg(F.count_if("is_completed").alias("completed"))
        .withColumn("total", total)
        .withColumn("percentage", success_rate(F.col("total"), F.col("completed")))
    )


def recent_progress(progress_rows: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    """Latest started exercises of every user."""
    return first_n(progress_rows, ["user_id"], [F.col("first_attempt_at").desc(), F.col("id").desc()], n)


def recent_submissions(submissions: DataFrame, by: Sequence[str] = ("user_id",), n: int = RECENT_ROWS) -> DataFrame:
    """Latest submissions per user, or per (user, exercise)."""
    return first_n(submissions, list(by), [F.col("submitted_at").desc(), F.col("id").desc()], n)


def first_attempt(page_views: DataFrame) -> DataFrame:
    """First page view of an exercise by a user: the start of their progress."""
    return page_views.groupBy("user_id", "exercise_id").agg(F.min("ts").alias("first_attempt_at"))
