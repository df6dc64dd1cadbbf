"""Sessions, mistakes, revision advice and the progress page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as txt
from ..operators import dashboard, sessions as ops
from .registry import query, table, view


@query(
    "filter_scored_quizzes",
    "SELECT id, user_id, score FROM <fx_sessions> s WHERE activity_type = 'quiz' AND score IS NOT NULL",
)
def filter_scored_quizzes(spark, folder):
    return ops.scored_quizzes(view(spark, folder, "fx_sessions")).select("id", "user_id", "score")


@query(
    "agg_user_stats",
    """SELECT user_id, CAST(sum(duration_seconds) AS BIGINT) AS total_time_seconds, count(*) AS total_sessions,
    round_even(coalesce(avg(score) FILTER (WHERE activity_type = 'quiz' AND score IS NOT NULL), 0), 1) AS average_score
    FROM <fx_sessions> s GROUP BY user_id""",
)
def agg_user_stats(spark, folder):
    return ops.user_stats(view(spark, folder, "fx_sessions"))


@query(
    "agg_topic_stats",
    """SELECT user_id, topic, count(*) AS sessions, CAST(sum(duration_seconds) AS BIGINT) AS time,
    coalesce(max_by(score, id) FILTER (WHERE score <> 0), 0) AS last_score, round(avg(score), 4) AS mean_score
    FROM <fx_sessions> s GROUP BY user_id, topic""",
)
def agg_topic_stats(spark, folder):
    return ops.topic_stats(view(spark, folder, "fx_sessions"))


_WEAK = """
WITH counts AS (SELECT user_id, topic, count(*) AS mistake_count, min(id) AS first_id FROM <fx_mistakes> m WHERE NOT reviewed GROUP BY user_id, topic),
weak AS (SELECT user_id, topic, mistake_count, row_number() OVER (PARTITION BY user_id ORDER BY mistake_count DESC, first_id) AS position FROM counts)
"""
_RECENT = """
recent AS (SELECT * FROM (SELECT user_id, topic, question, user_answer, correct_answer,
  row_number() OVER (PARTITION BY user_id, topic ORDER BY timestamp DESC, id DESC) AS position FROM <fx_mistakes> m WHERE NOT reviewed) t WHERE position <= 3)
"""


@query("agg_weak_topics", f"{_WEAK} SELECT user_id, topic, mistake_count, position FROM weak WHERE position <= 5")
def agg_weak_topics(spark, folder):
    return ops.weak_topics(view(spark, folder, "fx_mistakes"))


@query("win_recent_mistakes", f"WITH {_RECENT} SELECT * FROM recent")
def win_recent_mistakes(spark, folder):
    return ops.recent_mistakes(view(spark, folder, "fx_mistakes"))


@query(
    "win_revision_recommendations",
    f"""{_WEAK}, {_RECENT}
    SELECT w.user_id, w.position, w.topic, w.mistake_count, CASE WHEN w.mistake_count >= 3 THEN 'high' ELSE 'medium' END AS priority,
      string_agg(concat(r.question, ':', r.user_answer, ':', r.correct_answer), '|' ORDER BY r.position) AS recent
    FROM weak w JOIN recent r ON w.user_id = r.user_id AND w.topic = r.topic WHERE w.position <= 5
    GROUP BY w.user_id, w.position, w.topic, w.mistake_count""",
)
def win_revision_recommendations(spark, folder):
    shown = F.transform(
        "recent_mistakes",
        lambda m: F.concat_ws(":", m["question"], m["user_answer"], m["correct_answer"]),
    )
    return (
        ops.recommendations(view(spark, folder, "fx_mistakes"))
        .withColumn("recent", F.array_join(shown, "|"))
        .drop("recent_mistakes")
    )


@query(
    "sink_bulk_update_reviewed",
    """WITH pairs AS (SELECT DISTINCT user_id, topic FROM <fx_sessions> s WHERE activity_type = 'chat' AND duration_seconds > 6000)
    SELECT m.id, m.user_id, m.topic, m.reviewed OR p.user_id IS NOT NULL AS reviewed
    FROM <fx_mistakes> m LEFT JOIN pairs p ON m.user_id = p.user_id AND m.topic = p.topic""",
)
def sink_bulk_update_reviewed(spark, folder):
    revised = view(spark, folder, "fx_sessions").where(
        (F.col("activity_type") == "chat") & (F.col("duration_seconds") > 6000)
    )
    return ops.mark_reviewed(view(spark, folder, "fx_mistakes"), revised).select(
        "id", "user_id", "topic", "reviewed"
    )


@query(
    "fn_session_duration",
    """SELECT event_id AS session_id, CAST(trunc(epoch_us(ts + to_milliseconds(CAST(floor(value * 1000) AS BIGINT))) / 1000000.0 - epoch_us(ts) / 1000000.0 + 0.0000001) AS INT) AS duration_seconds
    FROM events""",
)
def fn_session_duration(spark, folder):
    ended = F.col("ts") + F.expr("make_dt_interval(0, 0, 0, CAST(floor(value * 1000) / 1000 AS DECIMAL(18, 6)))")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("session_id"),
        ops.duration_seconds(F.col("ts"), ended).alias("duration_seconds"),
    )


@query(
    "measured_weekday_minutes",
    """SELECT user_id, CAST(isodow(start_time) - 1 AS INT) AS weekday, CAST(floor(sum(duration_seconds) / 60) AS BIGINT) AS minutes
    FROM <fx_sessions> s GROUP BY ALL""",
)
def measured_weekday_minutes(spark, folder):
    return ops.weekday_minutes(view(spark, folder, "fx_sessions"))


@query(
    "agg_user_course_count",
    "SELECT created_by AS user_id, count(*) AS total_courses FROM <fx_courses> c GROUP BY created_by",
)
def agg_user_course_count(spark, folder):
    return dashboard.course_counts(view(spark, folder, "fx_courses"))


_STUDY = """
WITH counts AS (SELECT created_by, count(*) AS n FROM <fx_courses> c GROUP BY created_by),
minutes AS (SELECT u.*, coalesce(n, 0) AS total_courses,
  CASE WHEN total_study_time_minutes = 0 THEN coalesce(n, 0) * 25 ELSE total_study_time_minutes END AS study FROM <fx_users> u LEFT JOIN counts ON id = created_by),
days AS (SELECT *, least(150, study // 10) AS today FROM minutes)
"""


@query(
    "fn_dashboard_kpis",
    f"""{_STUDY}
    SELECT id AS user_id, total_courses, CAST(least(95, 60 + xp // 50) AS BIGINT) AS success_rate,
      concat(study // 60, 'h ', lpad(CAST(study % 60 AS VARCHAR), 2, '0'), 'm') AS total_study_time,
      concat(today // 60, 'h ', lpad(CAST(today % 60 AS VARCHAR), 2, '0'), 'm') AS today_study_time,
      least(3, total_courses_completed % 4) AS goal_courses, CAST(least(100, least(3, total_courses_completed % 4) * 100 // 3) AS BIGINT) AS goal_courses_pct,
      least(5, total_quizzes_completed % 6) AS goal_quizzes, CAST(least(100, least(5, total_quizzes_completed % 6) * 100 // 5) AS BIGINT) AS goal_quizzes_pct,
      today AS goal_minutes, least(100, today * 100 // 60) AS goal_minutes_pct,
      concat(today // 60, 'h ', lpad(CAST(today % 60 AS VARCHAR), 2, '0'), 'm / 1h') AS goal_minutes_text
    FROM days""",
)
def fn_dashboard_kpis(spark, folder):
    return dashboard.kpis(view(spark, folder, "fx_users"), view(spark, folder, "fx_courses"))


@query(
    "dashboard_week_bars",
    f"""{_STUDY}, bars AS (SELECT * FROM (VALUES (0,'Mon',60),(1,'Tue',30),(2,'Wed',90),(3,'Thu',0),(4,'Fri',20),(5,'Sat',45),(6,'Sun',75)) v(weekday, day, less))
    SELECT id AS user_id, weekday, day, greatest(0, today - less) AS minutes,
      greatest(0, least(100, CAST(floor((today - less) * 100 / 150) AS BIGINT))) AS percentage FROM days CROSS JOIN bars""",
)
def dashboard_week_bars(spark, folder):
    return dashboard.week_bars(view(spark, folder, "fx_users"), view(spark, folder, "fx_courses"))


_RECENT_COURSES = """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY created_by ORDER BY created_at DESC, id DESC) - 1 AS place FROM <fx_courses> c),
recent AS (SELECT r.created_by AS user_id, place, CASE WHEN length(title) > 30 THEN concat(title[1:30], '...') ELSE title END AS title,
  least(95, 70 + u.xp // 30 + place * 5) AS score, CASE WHEN place = 0 THEN '2h ago' ELSE concat(place + 1, ' days ago') END AS time_ago
  FROM ranked r JOIN <fx_users> u ON u.id = r.created_by WHERE place < 3),
shown AS (SELECT *, CASE WHEN score > 80 THEN 'Completed' ELSE 'In progress' END AS status FROM recent)
"""


@query("win_recent_courses", f"{_RECENT_COURSES} SELECT * FROM shown")
def win_recent_courses(spark, folder):
    return dashboard.recent_courses(view(spark, folder, "fx_courses"), view(spark, folder, "fx_users"))


@query(
    "union_padding_subjects",
    f"""{_RECENT_COURSES}, examples AS (SELECT * FROM (VALUES (0,'Python Basics',85,'3 days ago','Completed'),(1,'Web Development',72,'1 week ago','In progress'),
      (2,'Data Structures',90,'2 weeks ago','Completed')) v(place, title, score, time_ago, status))
    SELECT * FROM shown UNION ALL
    SELECT u.id, e.* FROM <fx_users> u CROSS JOIN examples e WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.user_id = u.id AND s.place = e.place)""",
)
def union_padding_subjects(spark, folder):
    users = view(spark, folder, "fx_users")
    return dashboard.pad_subjects(dashboard.recent_courses(view(spark, folder, "fx_courses"), users), users)


@query("fn_language_default", "SELECT id, coalesce(language_preference, 'fr') AS language FROM <fx_users> u")
def fn_language_default(spark, folder):
    return view(spark, folder, "fx_users").select(
        "id", txt.language(F.col("language_preference")).alias("language")
    )


@query(
    "fn_num_questions_clamp",
    """WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(CAST(floor(value) AS INT) AS VARCHAR) WHEN 1 THEN concat(' ', CAST(event_id % 60 AS VARCHAR), ' ')
      WHEN 2 THEN CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN concat('_', CAST(event_id % 9 AS VARCHAR)) ELSE concat('1_', CAST(event_id % 9 AS VARCHAR)) END ELSE concat('-', CAST(event_id % 9 AS VARCHAR)) END AS asked FROM events)
    SELECT event_id, CASE WHEN TRY_CAST(n AS INT) BETWEEN 1 AND 50 THEN TRY_CAST(n AS INT) ELSE 10 END AS num_questions
    FROM (SELECT event_id, CASE WHEN regexp_matches(trim(asked), '^[0-9]+_[0-9]+$') THEN replace(trim(asked), '_', '') WHEN contains(asked, '_') THEN NULL ELSE trim(asked) END AS n FROM t)""",
)
def fn_num_questions_clamp(spark, folder):
    asked = F.expr(
        """CASE event_id % 4 WHEN 0 THEN string(int(floor(value))) WHEN 1 THEN concat(' ', string(event_id % 60), ' ')
        WHEN 2 THEN CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN concat('_', string(event_id % 9)) ELSE concat('1_', string(event_id % 9)) END
        ELSE concat('-', string(event_id % 9)) END"""
    )
    return table(spark, folder, "events").select("event_id", txt.clamp_questions(asked).alias("num_questions"))


@query(
    "project_duration_text",
    """SELECT id, concat((duration_seconds // 60) // 60, 'h ', lpad(CAST((duration_seconds // 60) % 60 AS VARCHAR), 2, '0'), 'm') AS duration_text FROM <fx_sessions> s""",
)
def project_duration_text(spark, folder):
    minutes = F.floor(F.col("duration_seconds") / 60)
    return view(spark, folder, "fx_sessions").select("id", txt.hours_minutes(minutes).alias("duration_text"))
