"""Experience points, levels, titles, awards and answer points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the game rules.
MAX_LEVEL = 50
LINEAR_FROM_LEVEL = 10
LINEAR_STEP_XP = 1000
TITLE_BANDS = [
    (1, "Beginner"),
    (3, "Apprentice"),
    (5, "Student"),
    (8, "Developer"),
    (12, "Expert"),
    (20, "Master"),
    (30, "Sage"),
]
TOP_TITLE = "Legend"
COURSE_GENERATION_XP = 15
COURSE_SAVE_XP = 10
EXERCISE_XP = 20
ADVANCED_EXERCISE_XP = 10
QUIZ_XP = 10
STREAK_XP_CAP = 20
PODIUM_XP = 50
PODIUM_FLOOR_XP = 10
ANSWER_POINTS = 1000
SPEED_POINTS = 500
ANSWER_SECONDS = 60


def _floor_value(level: int) -> int:
    """XP at which ``level`` begins: 50·L·(L−1) up to level 10, then steps of 1000."""
    curved = min(level, LINEAR_FROM_LEVEL)
    return 50 * curved * (curved - 1) + LINEAR_STEP_XP * (level - curved)


def level(xp: Column) -> Column:
    """Level reached with ``xp``; 50 at most."""
    steps = sum(
        ((xp >= _floor_value(n)).cast("int") for n in range(2, LINEAR_FROM_LEVEL + 1)),
        F.lit(1),
    )
    beyond = F.floor((xp - _floor_value(LINEAR_FROM_LEVEL)) / LINEAR_STEP_XP).cast("int")
    return F.least(F.lit(MAX_LEVEL), steps + F.greatest(F.lit(0), beyond))


def level_floor(lvl: Column) -> Column:
    """XP at which a level begins, as a column (levels above 50 are extrapolated)."""
    curved = F.least(lvl, F.lit(LINEAR_FROM_LEVEL)).cast("long")
    return F.lit(50) * curved * (curved - 1) + LINEAR_STEP_XP * (lvl - curved)


def xp_for_current_level(xp: Column) -> Column:
    return level_floor(level(xp))


def xp_for_next_level(xp: Column) -> Column:
    return level_floor(level(xp) + 1)


def xp_in_level(xp: Column) -> Column:
    """XP gained since the level began; not clamped at level 50."""
    return xp - xp_for_current_level(xp)


def xp_needed(xp: Column) -> Column:
    """Width of the current level in XP."""
    return xp_for_next_level(xp) - xp_for_current_level(xp)


def xp_progress_percentage(xp: Column) -> Column:
    """Progress through the current level, 0 to 100."""
    share = xp_in_level(xp) / xp_needed(xp) * 100.0
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))


def level_title(lvl: Column) -> Column:
    chain = None
    for upper, name in TITLE_BANDS:
        test = lvl <= upper
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise(TOP_TITLE)


def podium_xp(rank: Column) -> Column:
    """Bonus for the 1-based place in a finished room: 50, 40, 30, 20, then 10."""
    return F.greatest(F.lit(PODIUM_XP) - (rank - 1) * 10, F.lit(PODIUM_FLOOR_XP))


def streak_xp(streak_before: Column) -> Column:
    """Quiz bonus for the day streak held before the quiz."""
    return F.least(streak_before * 2, F.lit(STREAK_XP_CAP))


def base_xp(activity_type: Column, difficulty: Column, score: Column, rank: Column) -> Column:
    """Award without the streak part; unknown activities earn nothing."""
    return (
        F.when(activity_type == "course_generation", F.lit(COURSE_GENERATION_XP))
        .when(activity_type == "course_save", F.lit(COURSE_SAVE_XP))
        .when(
            activity_type == "exercise_completion",
            F.lit(EXERCISE_XP)
            + F.when(difficulty == "advanced", ADVANCED_EXERCISE_XP).otherwise(0),
        )
        .when(
            activity_type == "quiz_completion",
            F.lit(QUIZ_XP) + F.coalesce((score / 10).cast("int"), F.lit(0)),
        )
        .when(activity_type == "multiplayer_quiz", podium_xp(rank).cast("int"))
        .otherwise(F.lit(0))
    ).cast("long")


def xp_award(
    activity_type: Column,
    difficulty: Column,
    score: Column,
    streak_before: Column,
    rank: Column | None = None,
) -> Column:
    """XP earned by one activity."""
    place = F.lit(1) if rank is None else rank
    bonus = F.when(activity_type == "quiz_completion", streak_xp(streak_before)).otherwise(0)
    return base_xp(activity_type, difficulty, score, place) + bonus


def is_correct(selected: Column, key: Column) -> Column:
    return selected == key


def answer_points(correct: Column, seconds: Column) -> Column:
    """0 if wrong; else 1000 plus up to 500 for speed. Not capped for negative times."""
    left = (F.lit(ANSWER_SECONDS) - seconds) / F.lit(float(ANSWER_SECONDS))
    speed = F.greatest(F.lit(0), (left * SPEED_POINTS).cast("int"))
    return F.when(correct, F.lit(ANSWER_POINTS) + speed).otherwise(F.lit(0))
