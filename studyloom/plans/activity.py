"""Streaks, awards, levels and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gamify
from ..operators import activity as ops
from .registry import query, view

_LEVEL = """CASE WHEN {x} < 100 THEN 1 WHEN {x} < 300 THEN 2 WHEN {x} < 600 THEN 3 WHEN {x} < 1000 THEN 4
  WHEN {x} < 1500 THEN 5 WHEN {x} < 2100 THEN 6 WHEN {x} < 2800 THEN 7 WHEN {x} < 3600 THEN 8
  WHEN {x} < 4500 THEN 9 ELSE least(10 + CAST(floor(({x} - 4500) / 1000) AS BIGINT), 50) END"""
_TITLE = """CASE WHEN {l} = 1 THEN 'Beginner' WHEN {l} <= 3 THEN 'Apprentice' WHEN {l} <= 5 THEN 'Student'
  WHEN {l} <= 8 THEN 'Developer' WHEN {l} <= 12 THEN 'Expert' WHEN {l} <= 20 THEN 'Master'
  WHEN {l} <= 30 THEN 'Sage' ELSE 'Legend' END"""
_START = """CASE {l} WHEN 1 THEN 0 WHEN 2 THEN 100 WHEN 3 THEN 300 WHEN 4 THEN 600 WHEN 5 THEN 1000 WHEN 6 THEN 1500
  WHEN 7 THEN 2100 WHEN 8 THEN 2800 WHEN 9 THEN 3600 ELSE ({l} - 10) * 1000 + 4500 END"""
_NEXT = """CASE {l} WHEN 1 THEN 100 WHEN 2 THEN 300 WHEN 3 THEN 600 WHEN 4 THEN 1000 WHEN 5 THEN 1500 WHEN 6 THEN 2100
  WHEN 7 THEN 2800 WHEN 8 THEN 3600 WHEN 9 THEN 4500 ELSE ({l} - 9) * 1000 + 4500 END"""


def level_sql(x):
    return _LEVEL.format(x=x)


def title_sql(lvl):
    return _TITLE.format(l=lvl)


_STREAKS = """
days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM <fx_activity> a),
islands AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island FROM days),
streaks AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id, island ORDER BY day) AS streak FROM islands)"""

LEDGER_SQL = f"""
WITH {_STREAKS},
aware AS (
  SELECT a.*, s.streak,
    coalesce(lag(s.streak) OVER (PARTITION BY a.user_id ORDER BY a.ts, a.activity_id), 0) AS streak_before
  FROM <fx_activity> a JOIN streaks s ON a.user_id = s.user_id AND CAST(a.ts AS DATE) = s.day),
awards AS (
  SELECT *, CASE activity_type WHEN 'course_generation' THEN 15 WHEN 'course_save' THEN 10
      WHEN 'exercise_completion' THEN 20 + CASE WHEN difficulty = 'advanced' THEN 10 ELSE 0 END
      WHEN 'quiz_completion' THEN 10 + CAST(floor(score / 10) AS BIGINT) + least(streak_before * 2, 20) ELSE 0 END AS xp_gained
  FROM aware),
ledger AS (
  SELECT *, CAST(sum(xp_gained) OVER (PARTITION BY user_id ORDER BY ts, activity_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_xp
  FROM awards),
levels AS (SELECT *, {_LEVEL.format(x='(total_xp - xp_gained)')} AS old_level, {_LEVEL.format(x='total_xp')} AS new_level FROM ledger)
"""

FLAGSHIP_SQL = f"""{LEDGER_SQL},
users AS (SELECT user_id, CAST(sum(xp_gained) AS BIGINT) AS xp, max(CAST(ts AS DATE)) AS last_activity_date FROM awards GROUP BY user_id),
ends AS (SELECT user_id, max(streak) AS longest_streak, max_by(streak, day) AS current_streak FROM streaks GROUP BY user_id),
graded AS (SELECT u.*, e.longest_streak, e.current_streak, {_LEVEL.format(x='xp')} AS level FROM users u JOIN ends e ON u.user_id = e.user_id)
SELECT user_id, xp, current_streak, longest_streak, CAST(last_activity_date AS VARCHAR) AS last_activity_date, level, {_TITLE.format(l='level')} AS title,
  round(least(100.0, greatest(0.0, (xp - ({_START.format(l='level')})) * 100.0 / (({_NEXT.format(l='level')}) - ({_START.format(l='level')})))), 4) AS progress
FROM graded"""


@query("learner_levels", FLAGSHIP_SQL)
def learner_levels(spark, folder):
    levels = ops.learner_levels(view(spark, folder, "fx_activity"))
    return levels.withColumn("last_activity_date", F.col("last_activity_date").cast("string"))


@query("win_streak", f"WITH {_STREAKS} SELECT user_id, CAST(day AS VARCHAR) AS day, streak FROM streaks")
def win_streak(spark, folder):
    streaks = ops.day_streaks(view(spark, folder, "fx_activity"))
    return streaks.withColumn("day", F.col("day").cast("string"))


@query("win_streak_before", f"{LEDGER_SQL} SELECT activity_id, user_id, streak, streak_before FROM aware")
def win_streak_before(spark, folder):
    return ops.with_streaks(view(spark, folder, "fx_activity")).select(
        "activity_id", "user_id", "streak", "streak_before"
    )


@query(
    "win_xp_ledger",
    f"""{LEDGER_SQL} SELECT activity_id, user_id, ts, activity_type, streak, streak_before, xp_gained, total_xp,
    old_level, new_level, new_level > old_level AS level_up FROM levels""",
)
def win_xp_ledger(spark, folder):
    return ops.xp_ledger(view(spark, folder, "fx_activity"))


@query("fn_xp_award", f"{LEDGER_SQL} SELECT activity_id, xp_gained FROM awards")
def fn_xp_award(spark, folder):
    award = gamify.xp_award(
        F.col("activity_type"), F.col("difficulty"), F.col("score"), F.col("streak_before")
    )
    return ops.with_streaks(view(spark, folder, "fx_activity")).select(
        "activity_id", award.alias("xp_gained")
    )


def _xp_users(spark, folder):
    return view(spark, folder, "fx_users").select("id", "xp", gamify.level(F.col("xp")).alias("level"))


_XP_USERS = f"WITH u AS (SELECT id, xp, {_LEVEL.format(x='xp')} AS level FROM <fx_users> f)"


@query("fn_level", f"{_XP_USERS} SELECT id, xp, level FROM u")
def fn_level(spark, folder):
    return _xp_users(spark, folder)


@query("fn_level_title", f"{_XP_USERS} SELECT id, level, {_TITLE.format(l='level')} AS title FROM u")
def fn_level_title(spark, folder):
    return _xp_users(spark, folder).select("id", "level", gamify.level_title(F.col("level")).alias("title"))


@query(
    "fn_xp_for_next_level", f"{_XP_USERS} SELECT id, {_NEXT.format(l='level')} AS xp_for_next_level FROM u"
)
def fn_xp_for_next_level(spark, folder):
    return _xp_users(spark, folder).select(
        "id", gamify.xp_for_next_level(F.col("xp")).alias("xp_for_next_level")
    )


@query(
    "fn_xp_for_current_level",
    f"{_XP_USERS} SELECT id, {_START.format(l='level')} AS xp_for_current_level FROM u",
)
def fn_xp_for_current_level(spark, folder):
    return _xp_users(spark, folder).select(
        "id", gamify.xp_for_current_level(F.col("xp")).alias("xp_for_current_level")
    )


@query(
    "fn_xp_progress_percentage",
    f"""{_XP_USERS}, b AS (SELECT id, xp, {_START.format(l='level')} AS lo, {_NEXT.format(l='level')} AS hi FROM u)
    SELECT id, round(least(100.0, greatest(0.0, (xp - lo) * 100.0 / (hi - lo))), 4) AS progress FROM b""",
)
def fn_xp_progress_percentage(spark, folder):
    return _xp_users(spark, folder).select(
        "id", F.round(gamify.xp_progress_percentage(F.col("xp")), 4).alias("progress")
    )


@query(
    "fn_xp_in_level",
    f"{_XP_USERS} SELECT id, xp - ({_START.format(l='level')}) AS xp_in_level FROM u",
)
def fn_xp_in_level(spark, folder):
    return _xp_users(spark, folder).select("id", gamify.xp_in_level(F.col("xp")).alias("xp_in_level"))


@query(
    "fn_xp_needed",
    f"{_XP_USERS} SELECT id, ({_NEXT.format(l='level')}) - ({_START.format(l='level')}) AS xp_needed FROM u",
)
def fn_xp_needed(spark, folder):
    return _xp_users(spark, folder).select("id", gamify.xp_needed(F.col("xp")).alias("xp_needed"))
