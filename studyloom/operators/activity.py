"""Day streaks and the experience ledger, set-wise over an activity log.

``activity`` has activity_id, user_id, ts, activity_type, difficulty, score and,
where results of rooms are among it, rank (the place in the room).
The work is cut at time slices: everything that concerns a whole user runs on
(user, slice) rows, which the calendar bounds, and the log itself is shuffled
once, by (user, hour).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gamify

EVENT_ORDER = ("ts", "activity_id")


def day_streaks(activity: DataFrame) -> DataFrame:
    """One row per (user_id, day) with the streak held at the end of that day."""
    days = activity.select("user_id", F.to_date("ts").alias("day")).distinct()
    user = Window.partitionBy("user_id").orderBy("day")
    island = Window.partitionBy("user_id", "island").orderBy("day")
    return (
        days.withColumn("island", F.date_sub("day", F.row_number().over(user)))
        .withColumn("streak", F.row_number().over(island))
        .select("user_id", "day", "streak")
    )


def _is_quiz(kind: Column) -> Column:
    return kind == "quiz_completion"


def _rank(activity: DataFrame) -> Column:
    return F.col("rank") if "rank" in activity.columns else F.lit(1)


def _fixed_xp(activity: DataFrame) -> Column:
    """The part of an award that does not depend on the streak."""
    return gamify.base_xp(F.col("activity_type"), F.col("difficulty"), F.col("score"), _rank(activity))


# The first activity of a group by (time, id), with its quiz bit, in one number:
# a minimum of fixed width stays in a hash aggregate, one of structs does not.
_TIME_UNIT = "100000000000000000000"
_ID_SHIFT = "9223372036854775808"


def _first_event() -> Column:
    return F.min(F.expr(
        f"CAST(unix_micros(CAST(ts AS timestamp)) AS DECIMAL(18,0)) * CAST({_TIME_UNIT} AS DECIMAL(21,0))"
        f" + (CAST(activity_id AS DECIMAL(19,0)) + CAST({_ID_SHIFT} AS DECIMAL(19,0))) * 2"
        " + CAST(coalesce(activity_type = 'quiz_completion', false) AS INT)"
    ))


def _event_id(code: str) -> Column:
    rest = f"pmod({code}, CAST({_TIME_UNIT} AS DECIMAL(21,0)))"
    return F.expr(f"CAST(({rest} - {rest} % 2) / 2 - CAST({_ID_SHIFT} AS DECIMAL(19,0)) AS BIGINT)")


def _event_is_quiz(code: str) -> Column:
    return F.expr(f"pmod({code}, 2) = 1")


ACCOUNTS = "user_id long, total long, streak int, day date"


def _with_accounts(slices: DataFrame, accounts: DataFrame | None) -> DataFrame:
    """Slices with what their user held before this log; nulls for a new user."""
    held = {"total": "long", "streak": "int", "day": "date"}
    if accounts is None:
        return slices.select("*", *[F.lit(None).cast(t).alias(f"held_{c}") for c, t in held.items()])
    return slices.join(accounts.select("user_id", *[F.col(c).alias(f"held_{c}") for c in held]), "user_id", "left")


def time_slices(activity: DataFrame, grain: str = "hour", accounts: DataFrame | None = None) -> DataFrame:
    """Per (user_id, slice): streak context and XP earned before the slice.

    ``grain`` is the width of a slice, a day at most. Inside a day every
    activity but the first sees the streak of that day; the first sees the
    streak of the previous active day. So the XP of a slice follows from sums
    and its first activity, without visiting single rows. ``accounts``
    (``ACCOUNTS``) is where users stood before this log: XP, streak and last
    active day. Activities of an earlier day than that one count to it.
    """
    slices = (
        activity.withColumn("slice", F.date_trunc(grain, "ts"))
        .groupBy("user_id", "slice")
        .agg(
            F.sum(_fixed_xp(activity)).alias("fixed_xp"),
            F.count_if(_is_quiz(F.col("activity_type"))).alias("quizzes"),
            _first_event().alias("first_event"),
        )
    )
    slices = _with_accounts(slices, accounts).withColumn("day", F.greatest(F.to_date("slice"), "held_day"))
    # One order for all windows, so the (user, slice) rows are sorted once. A
    # streak is the number of days so far less those before its run of days.
    order = Window.partitionBy("user_id").orderBy("slice")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.datediff("day", F.coalesce(F.lag("day").over(order), "held_day"))
    marked = (
        slices.withColumn("gap", gap)
        .withColumn("opens_day", F.col("gap").isNull() | (F.col("gap") > 0))
        .withColumn("opens_run", F.col("gap").isNull() | (F.col("gap") > 1))
        .withColumn("days", F.count_if("opens_day").over(running))
        .withColumn("run_start", F.max(F.when(F.col("opens_run"), F.col("days"))).over(running))
        # without a run of its own so far, the log goes on with the one held
        .withColumn("streak", (F.col("days") + F.coalesce(1 - F.col("run_start"), "held_streak")).cast("int"))
        .withColumn("streak_yesterday", F.coalesce(F.lag("streak").over(order), "held_streak", F.lit(0)))
    )
    opening_quiz = F.col("opens_day") & _event_is_quiz("first_event")
    slice_xp = (
        F.col("fixed_xp")
        + (F.col("quizzes") - opening_quiz.cast("int")) * gamify.streak_xp(F.col("streak"))
        + F.when(opening_quiz, gamify.streak_xp(F.col("streak_yesterday"))).otherwise(0)
    )
    return marked.withColumn("slice_xp", slice_xp).select(
        "user_id",
        "slice",
        "day",
        "streak",
        "streak_yesterday",
        F.when(F.col("opens_day"), _event_id("first_event")).alias("opening_id"),
        "slice_xp",
        (F.coalesce(F.sum("slice_xp").over(earlier), F.lit(0)) + F.coalesce("held_total", F.lit(0))).alias("xp_before_slice"),
    )


def with_streaks(activity: DataFrame, accounts: DataFrame | None = None, slices: DataFrame | None = None) -> DataFrame:
    """The log with ``streak`` (after the activity) and ``streak_before`` it.

    ``slices`` are its hourly ``time_slices``, where the caller has them.
    """
    slices = time_slices(activity, accounts=accounts) if slices is None else slices
    opening = F.col("activity_id").eqNullSafe(F.col("opening_id"))
    return (
        activity.withColumn("slice", F.date_trunc("hour", "ts"))
        .join(slices.drop("day"), ["user_id", "slice"])
        .withColumn("streak_before", F.when(opening, F.col("streak_yesterday")).otherwise(F.col("streak")))
    )


def xp_ledger(activity: DataFrame, accounts: DataFrame | None = None, slices: DataFrame | None = None) -> DataFrame:
    """One row per activity: XP gained, running total, levels, level-up flag.

    ``accounts`` as in ``time_slices``, ``slices`` as in ``with_streaks``.
    """
    inside = (
        Window.partitionBy("user_id", "slice").orderBy(*EVENT_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    )
    gained = gamify.xp_award(
        F.col("activity_type"), F.col("difficulty"), F.col("score"), F.col("streak_before"), _rank(activity)
    )
    total = F.col("xp_before_slice") + F.sum("xp_gained").over(inside)
    return (
        with_streaks(activity, accounts, slices)
        .withColumn("xp_gained", gained)
        .withColumn("total_xp", total)
        .withColumn("old_level", gamify.level(F.col("total_xp") - F.col("xp_gained")))
        .withColumn("new_level", gamify.level(F.col("total_xp")))
        .select(
            "activity_id",
            "user_id",
            "ts",
            "activity_type",
            "streak",
            "streak_before",
            "xp_gained",
            "total_xp",
            "old_level",
            "new_level",
            (F.col("new_level") > F.col("old_level")).alias("level_up"),
        )
    )


def accounts_after(slices: DataFrame, accounts: DataFrame) -> DataFrame:
    """Where users stand after a log (``ACCOUNTS``), given by its time slices; other users stay where they were."""
    moved = slices.groupBy("user_id").agg(
        F.max_by(F.col("xp_before_slice") + F.col("slice_xp"), "slice").alias("total"),
        F.max_by("streak", "slice").alias("streak"),
        F.max("day").alias("day"),
    )
    return accounts.join(moved, "user_id", "left_anti").unionByName(moved)


def learner_levels(activity: DataFrame) -> DataFrame:
    """One row per user: final XP, level, title and streaks.

    Needs no per-activity shuffle: the (user, day) rows carry all of it.
    """
    return (
        time_slices(activity, "day")
        .groupBy("user_id")
        .agg(
            F.sum("slice_xp").alias("xp"),
            F.max_by("streak", "slice").alias("current_streak"),
            F.max("streak").alias("longest_streak"),
            F.to_date(F.max("slice")).alias("last_activity_date"),
        )
        .withColumn("level", gamify.level(F.col("xp")))
        .withColumn("title", gamify.level_title(F.col("level")))
        .withColumn("progress", F.round(gamify.xp_progress_percentage(F.col("xp")), 4))
    )
