"""Study sessions, mistakes and revision advice.

``sessions``: id, user_id, topic, activity_type, start_time, duration_seconds,
score. ``mistakes``: id, user_id, topic, question, user_answer, correct_answer,
timestamp, reviewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import first_n

WEAK_TOPICS = 5
RECENT_MISTAKES = 3
HIGH_PRIORITY_FROM = 3


def scored_quizzes(sessions: DataFrame) -> DataFrame:
    return sessions.where((F.col("activity_type") == "quiz") & F.col("score").isNotNull())


def user_stats(sessions: DataFrame) -> DataFrame:
    """Per user: total time, number of sessions, mean score of scored quizzes."""
    quiz_score = F.when(F.col("activity_type") == "quiz", F.col("score"))
    return sessions.groupBy("user_id").agg(
        F.sum(F.coalesce("duration_seconds", F.lit(0))).alias("total_time_seconds"),
        F.count("*").alias("total_sessions"),
        F.bround(F.coalesce(F.avg(quiz_score), F.lit(0.0)), 1).alias("average_score"),
    )


def topic_stats(sessions: DataFrame) -> DataFrame:
    """Per (user, topic): sessions, time, last non-zero score and true mean score."""
    has_score = F.coalesce(F.col("score") != 0, F.lit(False))
    return sessions.groupBy("user_id", "topic").agg(
        F.count("*").alias("sessions"),
        F.sum(F.coalesce("duration_seconds", F.lit(0))).alias("time"),
        F.coalesce(
            F.max_by(F.when(has_score, F.col("score")), F.when(has_score, F.col("id"))), F.lit(0.0)
        ).alias("last_score"),
        F.round(F.avg("score"), 4).alias("mean_score"),
    )


def weak_topics(mistakes: DataFrame, limit: int = WEAK_TOPICS) -> DataFrame:
    """Topics with most open mistakes per user; ties by first appearance."""
    counts = (
        mistakes.where(~F.col("reviewed"))
        .groupBy("user_id", "topic")
        .agg(F.count("*").alias("mistake_count"), F.min("id").alias("first_id"))
    )
    order = [F.col("mistake_count").desc(), F.col("first_id")]
    return first_n(counts, ["user_id"], order, limit).drop("first_id")


def recent_mistakes(mistakes: DataFrame, n: int = RECENT_MISTAKES) -> DataFrame:
    """The latest open mistakes of every (user, topic), one row each."""
    order = [F.col("timestamp").desc(), F.col("id").desc()]
    return first_n(mistakes.where(~F.col("reviewed")), ["user_id", "topic"], order, n).select(
        "user_id", "topic", "position", "question", "user_answer", "correct_answer"
    )


def recommendations(mistakes: DataFrame) -> DataFrame:
    """Weak topics with a priority and the latest mistakes as a nested list.

    The lists hold at most three entries, so they are bounded by construction.
    """
    lists = (
        recent_mistakes(mistakes)
        .groupBy("user_id", "topic")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("position", "question", "user_answer", "correct_answer"))
            ).alias("recent_mistakes")
        )
    )
    priority = F.when(F.col("mistake_count") >= HIGH_PRIORITY_FROM, "high").otherwise("medium")
    return (
        weak_topics(mistakes)
        .join(lists, ["user_id", "topic"])
        .select("user_id", "position", "topic", "mistake_count", priority.alias("priority"), "recent_mistakes")
    )


def mark_reviewed(mistakes: DataFrame, pairs: DataFrame) -> DataFrame:
    """New snapshot with the open mistakes of the given (user_id, topic) closed."""
    marks = pairs.select("user_id", "topic").distinct().withColumn("__mark", F.lit(True))
    return (
        mistakes.join(marks, ["user_id", "topic"], "left")
        .withColumn("reviewed", F.col("reviewed") | F.coalesce("__mark", F.lit(False)))
        .select(*mistakes.columns)
    )


def pair_sessions(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Close sessions: duration in whole seconds and score.

    Sessions without an end stay open; ends of unknown sessions give no row.
    Where a session is ended twice the last end counts.
    """
    last_end = ends.groupBy("session_id", "user_id").agg(
        F.max("end_time").alias("end_time"),
        F.max_by("score", F.when(F.col("score").isNotNull(), F.col("end_time"))).alias("score"),
    )
    return starts.join(last_end, ["session_id", "user_id"], "left").withColumn(
        "duration_seconds", F.coalesce(duration_seconds(F.col("start_time"), F.col("end_time")), F.lit(0))
    )


def duration_seconds(start, end):
    """Whole seconds between two times, cut towards zero."""
    return (
        (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000000
    ).cast("int")


def weekday_minutes(sessions: DataFrame) -> DataFrame:
    """Measured study minutes per user and weekday (Monday is 0)."""
    return (
        sessions.groupBy("user_id", F.weekday("start_time").alias("weekday"))
        .agg(F.sum(F.coalesce("duration_seconds", F.lit(0))).alias("seconds"))
        .select("user_id", "weekday", F.floor(F.col("seconds") / 60).alias("minutes"))
    )
