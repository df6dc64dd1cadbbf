"""Progress page figures: formulas over user counters, and recent subjects.

``users``: id, xp, total_courses_completed, total_quizzes_completed,
total_study_time_minutes. ``courses``: id, title, created_by, created_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hours_minutes, truncate
from .ordered import first_n

# Fixed values of the progress page.
MINUTES_PER_COURSE = 25
DAY_CAP_MINUTES = 150
WEEKDAY_OFFSETS = [
    ("Mon", 60),
    ("Tue", 30),
    ("Wed", 90),
    ("Thu", 0),
    ("Fri", 20),
    ("Sat", 45),
    ("Sun", 75),
]
GOAL_COURSES = 3
GOAL_QUIZZES = 5
GOAL_MINUTES = 60
SUBJECTS_SHOWN = 3
EXAMPLE_SUBJECTS = [
    (0, "Python Basics", 85, "3 days ago", "Completed"),
    (1, "Web Development", 72, "1 week ago", "In progress"),
    (2, "Data Structures", 90, "2 weeks ago", "Completed"),
]


def course_counts(courses: DataFrame) -> DataFrame:
    return courses.groupBy(F.col("created_by").alias("user_id")).agg(F.count("*").alias("total_courses"))


def study_minutes(users: DataFrame, courses: DataFrame) -> DataFrame:
    """Users with course count, study minutes and today's share of them."""
    joined = users.join(
        course_counts(courses).withColumnRenamed("user_id", "id"), "id", "left"
    ).withColumn("total_courses", F.coalesce("total_courses", F.lit(0)))
    total = F.coalesce(
        F.nullif("total_study_time_minutes", F.lit(0)).cast("long"),
        F.col("total_courses") * MINUTES_PER_COURSE,
    )
    return joined.withColumn("study_minutes", total).withColumn(
        "today_minutes", F.least(F.lit(DAY_CAP_MINUTES), F.floor(F.col("study_minutes") / 10))
    )


def _percent(part, whole):
    return F.least(F.lit(100), F.floor(part * 100 / whole))


def kpis(users: DataFrame, courses: DataFrame) -> DataFrame:
    """One row per user with the headline figures and goals."""
    today = F.col("today_minutes")
    weekly_courses = F.least(F.lit(GOAL_COURSES), F.col("total_courses_completed") % (GOAL_COURSES + 1))
    weekly_quizzes = F.least(F.lit(GOAL_QUIZZES), F.col("total_quizzes_completed") % (GOAL_QUIZZES + 1))
    return study_minutes(users, courses).select(
        F.col("id").alias("user_id"),
        "total_courses",
        F.least(F.lit(95), F.floor(F.col("xp") / 50) + 60).alias("success_rate"),
        hours_minutes(F.col("study_minutes")).alias("total_study_time"),
        hours_minutes(today).alias("today_study_time"),
        weekly_courses.alias("goal_courses"),
        _percent(weekly_courses, GOAL_COURSES).alias("goal_courses_pct"),
        weekly_quizzes.alias("goal_quizzes"),
        _percent(weekly_quizzes, GOAL_QUIZZES).alias("goal_quizzes_pct"),
        today.alias("goal_minutes"),
        _percent(today, GOAL_MINUTES).alias("goal_minutes_pct"),
        F.concat(hours_minutes(today), F.lit(f" / {GOAL_MINUTES // 60}h")).alias("goal_minutes_text"),
    )


def week_bars(users: DataFrame, courses: DataFrame) -> DataFrame:
    """Seven rows per user: minutes and percentage of each weekday."""
    bars = F.array(
        *[
            F.struct(F.lit(i).alias("weekday"), F.lit(day).alias("day"), F.lit(less).alias("less"))
            for i, (day, less) in enumerate(WEEKDAY_OFFSETS)
        ]
    )
    shifted = F.col("today_minutes") - F.col("bar.less")
    return (
        study_minutes(users, courses)
        .select(F.col("id").alias("user_id"), "today_minutes", F.explode(bars).alias("bar"))
        .select(
            "user_id",
            "bar.weekday",
            "bar.day",
            F.greatest(F.lit(0), shifted).alias("minutes"),
            F.greatest(F.lit(0), _percent(shifted, DAY_CAP_MINUTES)).alias("percentage"),
        )
    )


def recent_courses(courses: DataFrame, users: DataFrame, n: int = SUBJECTS_SHOWN) -> DataFrame:
    """The newest courses of every owner with a score made from XP."""
    newest = first_n(
        courses.select("id", "title", F.col("created_by").alias("user_id"), "created_at"),
        ["user_id"],
        [F.col("created_at").desc(), F.col("id").desc()],
        n,
    )
    place = F.col("position") - 1
    score = F.least(F.lit(95), 70 + F.floor(F.col("xp") / 30) + place * 5)
    return (
        newest.join(users.select(F.col("id").alias("user_id"), "xp"), "user_id")
        .withColumn("score", score)
        .select(
            "user_id",
            place.alias("place"),
            truncate(F.col("title")).alias("title"),
            "score",
            F.when(place == 0, "2h ago")
            .otherwise(F.concat((place + 1).cast("string"), F.lit(" days ago")))
            .alias("time_ago"),
            F.when(F.col("score") > 80, "Completed").otherwise("In progress").alias("status"),
        )
    )


def pad_subjects(recent: DataFrame, users: DataFrame) -> DataFrame:
    """Three rows per user: missing places are filled with the fixed examples."""
    fields = ["title", "score", "time_ago", "status"]
    examples = F.array(
        *[F.struct(*[F.lit(v).alias(f) for f, v in zip(["place", *fields], row)]) for row in EXAMPLE_SUBJECTS]
    )
    places = users.select(F.col("id").alias("user_id"), F.explode(examples).alias("e")).withColumn(
        "place", F.col("e.place")
    )
    own = recent.select("user_id", "place", F.struct(*fields).alias("r"))
    taken = F.col("r").isNotNull()
    return places.join(own, ["user_id", "place"], "left").select(
        "user_id", "place", *[F.when(taken, F.col(f"r.{f}")).otherwise(F.col(f"e.{f}")).alias(f) for f in fields]
    )
