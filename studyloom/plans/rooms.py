"""Live quiz rooms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gamify
from ..operators import rooms as ops
from ..session import shared_folder
from ..sources.sinks import write_snapshot
from .registry import query, table, view


def _inputs(spark, folder):
    return {
        name: view(spark, folder, f"fx_{name}")
        for name in ("rooms", "participants", "questions", "answers", "users")
    }


def _scores(x):
    return ops.participant_scores(x["answers"], x["questions"])


def _players(spark, x):
    """Active players with their scores, written once as the ranking reads them several times."""
    players = ops.with_scores(ops.active(x["participants"]), _scores(x))
    return write_snapshot(players, shared_folder(spark, "players"))


SCORED_SQL = """scored AS (SELECT a.*, q.correct_answer, a.selected_answer = q.correct_answer AS is_correct,
  CASE WHEN a.selected_answer = q.correct_answer THEN 1000 + greatest(0, CAST(trunc((60 - a.response_time) / 60 * 500) AS INT)) ELSE 0 END AS points
  FROM <fx_answers> a JOIN <fx_questions> q ON a.room_id = q.room_id AND a.question_number = q.question_number),
scores AS (SELECT room_id, user_id, CAST(sum(points) AS BIGINT) AS score, count(*) FILTER (WHERE is_correct) AS correct_answers FROM scored GROUP BY room_id, user_id),
players AS (SELECT p.*, coalesce(s.score, 0) AS score, coalesce(s.correct_answers, 0) AS correct_answers FROM <fx_participants> p
  LEFT JOIN scores s ON s.room_id = p.room_id AND s.user_id = p.user_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY score DESC, joined_at, user_id) AS position FROM players WHERE is_active)"""


@query("filter_open_rooms", "SELECT id, code, status FROM <fx_rooms> r WHERE status IN ('waiting', 'starting')")
def filter_open_rooms(spark, folder):
    return ops.open_rooms(view(spark, folder, "fx_rooms")).select("id", "code", "status")


@query(
    "topk_open_rooms",
    "SELECT id, code, created_at FROM <fx_rooms> r WHERE status IN ('waiting', 'starting') ORDER BY created_at DESC, id DESC LIMIT 10",
)
def topk_open_rooms(spark, folder):
    return ops.newest_open(view(spark, folder, "fx_rooms")).select("id", "code", "created_at")


@query("filter_active_players", "SELECT room_id, user_id FROM <fx_participants> p WHERE is_active")
def filter_active_players(spark, folder):
    return ops.active(view(spark, folder, "fx_participants")).select("room_id", "user_id")


@query(
    "agg_room_players",
    "SELECT room_id, count(*) FILTER (WHERE is_active) AS player_count FROM <fx_participants> p GROUP BY room_id",
)
def agg_room_players(spark, folder):
    return ops.room_players(view(spark, folder, "fx_participants"))


@query(
    "predicate_room_full",
    """SELECT r.id AS room_id, max_players, coalesce(n, 0) AS player_count, coalesce(n, 0) >= max_players AS is_full
    FROM <fx_rooms> r LEFT JOIN (SELECT room_id, count(*) AS n FROM <fx_participants> p WHERE is_active GROUP BY room_id) c ON c.room_id = r.id""",
)
def predicate_room_full(spark, folder):
    x = _inputs(spark, folder)
    return ops.room_full(x["rooms"], x["participants"])


@query(
    "sort_participants_joined",
    """SELECT room_id, user_id, joined_at, row_number() OVER (PARTITION BY room_id ORDER BY joined_at, user_id) AS position
    FROM <fx_participants> p WHERE is_active""",
)
def sort_participants_joined(spark, folder):
    return ops.waiting_list(view(spark, folder, "fx_participants")).drop("is_active")


@query(
    "join_participant_user",
    "SELECT p.room_id, p.user_id, u.username FROM <fx_participants> p JOIN <fx_users> u ON u.id = p.user_id",
)
def join_participant_user(spark, folder):
    x = _inputs(spark, folder)
    return ops.player_names(x["participants"], x["users"]).select("room_id", "user_id", "username")


@query(
    "join_room_host", "SELECT r.id, r.code, u.username AS host FROM <fx_rooms> r JOIN <fx_users> u ON u.id = r.host_id"
)
def join_room_host(spark, folder):
    x = _inputs(spark, folder)
    return ops.with_host(x["rooms"], x["users"]).select("id", "code", "host")


@query(
    "project_room_state",
    f"""WITH {SCORED_SQL}
    SELECT r.id, r.code, r.topic, r.status, r.current_question, r.num_questions, h.username AS host, u.username, p.score, p.correct_answers
    FROM <fx_rooms> r JOIN <fx_users> h ON h.id = r.host_id LEFT JOIN (players p JOIN <fx_users> u ON u.id = p.user_id) ON p.room_id = r.id AND p.is_active""",
)
def project_room_state(spark, folder):
    x = _inputs(spark, folder)
    return ops.room_state(x["rooms"], x["participants"], x["users"], _scores(x))


@query(
    "join_answer_question",
    f"WITH {SCORED_SQL} SELECT room_id, user_id, question_number, selected_answer, correct_answer, is_correct FROM scored",
)
def join_answer_question(spark, folder):
    x = _inputs(spark, folder)
    return ops.with_key(x["answers"], x["questions"]).select(
        "room_id", "user_id", "question_number", "selected_answer", "correct_answer", "is_correct"
    )


@query("fn_is_correct", f"WITH {SCORED_SQL} SELECT room_id, question_number, count(*) FILTER (WHERE is_correct) AS hits FROM scored GROUP BY ALL")
def fn_is_correct(spark, folder):
    x = _inputs(spark, folder)
    hit = gamify.is_correct(F.col("selected_answer"), F.col("correct_answer"))
    return (
        x["answers"]
        .join(x["questions"], ["room_id", "question_number"])
        .groupBy("room_id", "question_number")
        .agg(F.count_if(hit).alias("hits"))
    )


@query("fn_answer_points", f"WITH {SCORED_SQL} SELECT room_id, user_id, question_number, points FROM scored")
def fn_answer_points(spark, folder):
    x = _inputs(spark, folder)
    return ops.score_answers(x["answers"], x["questions"]).select("room_id", "user_id", "question_number", "points")


@query("agg_participant_scores", f"WITH {SCORED_SQL} SELECT * FROM scores")
def agg_participant_scores(spark, folder):
    return _scores(_inputs(spark, folder))


@query(
    "join_answers_of_current_question",
    """SELECT a.room_id, a.user_id, a.question_number, a.selected_answer FROM <fx_answers> a JOIN <fx_rooms> r
    ON r.id = a.room_id AND r.current_question = a.question_number""",
)
def join_answers_of_current_question(spark, folder):
    x = _inputs(spark, folder)
    return ops.current_answers(x["rooms"], x["answers"]).select(
        "room_id", "user_id", "question_number", "selected_answer"
    )


@query(
    "agg_all_answered",
    """WITH given AS (SELECT a.room_id, count(*) AS answered FROM <fx_answers> a JOIN <fx_rooms> r ON r.id = a.room_id AND r.current_question = a.question_number GROUP BY a.room_id),
    active AS (SELECT room_id, count(*) AS players FROM <fx_participants> p WHERE is_active GROUP BY room_id)
    SELECT r.id AS room_id, r.current_question, r.num_questions, coalesce(answered, 0) AS answered, coalesce(players, 0) AS players,
      coalesce(answered, 0) >= coalesce(players, 0) AS all_answered
    FROM <fx_rooms> r LEFT JOIN given g ON g.room_id = r.id LEFT JOIN active a ON a.room_id = r.id""",
)
def agg_all_answered(spark, folder):
    x = _inputs(spark, folder)
    return ops.all_answered(x["rooms"], x["answers"], x["participants"])


@query(
    "semi_has_answered",
    """WITH fresh AS (SELECT id, room_id, user_id, question_number FROM <fx_answer_log> l)
    SELECT f.*, EXISTS (SELECT 1 FROM <fx_answers> a WHERE a.room_id = f.room_id AND a.user_id = f.user_id AND a.question_number = f.question_number
      AND a.selected_answer >= 2) AS has_answered FROM fresh f""",
)
def semi_has_answered(spark, folder):
    fresh = view(spark, folder, "fx_answer_log").select("id", "room_id", "user_id", "question_number")
    return ops.has_answered(fresh, view(spark, folder, "fx_answers").where("selected_answer >= 2"))


@query(
    "semi_is_member",
    """SELECT l.id, l.room_id, l.user_id FROM <fx_answer_log> l
    WHERE EXISTS (SELECT 1 FROM <fx_participants> p WHERE p.room_id = l.room_id AND p.user_id = l.user_id AND p.is_active)""",
)
def semi_is_member(spark, folder):
    x = _inputs(spark, folder)
    return ops.only_members(view(spark, folder, "fx_answer_log"), x["participants"]).select("id", "room_id", "user_id")


@query(
    "agg_answer_histogram",
    """SELECT room_id, question_number, count(*) FILTER (WHERE selected_answer = 0) AS a, count(*) FILTER (WHERE selected_answer = 1) AS b,
    count(*) FILTER (WHERE selected_answer = 2) AS c, count(*) FILTER (WHERE selected_answer IN (3, -1)) AS d,
    count(*) FILTER (WHERE selected_answer = 3) AS d_chosen, count(*) FILTER (WHERE selected_answer = -1) AS timeouts
    FROM <fx_answers> s GROUP BY room_id, question_number""",
)
def agg_answer_histogram(spark, folder):
    stats = ops.answer_histogram(view(spark, folder, "fx_answers"))
    return stats.select(
        "room_id",
        "question_number",
        *[F.col("stats")[i].alias(n) for i, n in enumerate("abcd")],
        F.col("options")[3].alias("d_chosen"),
        "timeouts",
    )


@query(
    "win_leaderboard",
    f"""WITH {SCORED_SQL} SELECT room_id, user_id, score, correct_answers, position,
    CASE position WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' END AS medal FROM ranked""",
)
def win_leaderboard(spark, folder):
    return ops.ranked(_players(spark, _inputs(spark, folder))).select(
        "room_id", "user_id", "score", "correct_answers", "position", "medal"
    )


FINAL_SQL = f"""WITH {SCORED_SQL} SELECT k.room_id, k.user_id, k.position AS rank, k.score, k.correct_answers, r.num_questions AS total_questions,
    round_even(k.correct_answers / r.num_questions * 100, 1) AS accuracy, greatest(50 - (k.position - 1) * 10, 10) AS bonus_xp
    FROM ranked k JOIN <fx_rooms> r ON r.id = k.room_id"""


@query("win_final_results", FINAL_SQL)
def win_final_results(spark, folder):
    x = _inputs(spark, folder)
    return ops.results(x["rooms"], ops.ranked(_players(spark, x)))


@query(
    "join_case_insensitive_identity",
    """WITH logins AS (SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN upper(concat('customer#', lpad(CAST(user_id AS VARCHAR), 9, '0')))
      WHEN 1 THEN concat('CUSTOMER#', lpad(CAST(user_id AS VARCHAR), 9, '0'), '@mail.TEST') ELSE concat('nobody', user_id) END AS login FROM events),
    hits AS (SELECT DISTINCT l.login, u.id FROM logins l JOIN <fx_users> u ON lower(u.email) = lower(l.login) OR lower(u.username) = lower(l.login))
    SELECT login, count(*) AS matches, CASE WHEN count(*) = 1 THEN min(id) END AS user_id FROM hits GROUP BY login""",
)
def join_case_insensitive_identity(spark, folder):
    number = F.lpad(F.col("user_id").cast("string"), 9, "0")
    login = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("CUSTOMER#"), number))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("CUSTOMER#"), number, F.lit("@mail.TEST")))
        .otherwise(F.concat(F.lit("nobody"), F.col("user_id").cast("string")))
    )
    return ops.resolve_users(table(spark, folder, "events").select(login.alias("login")), view(spark, folder, "fx_users"))
