"""Live quiz rooms: players, answers, scores and rankings.

``rooms``: id, code, host_id, topic, num_questions, max_players, status,
current_question, created_at. ``participants``: room_id, user_id, joined_at,
is_active. ``questions``: room_id, question_number, correct_answer.
``answers``: room_id, user_id, question_number, selected_answer,
response_time, answered_at.

Rankings are numbered in bands of about equal size and the waiting list by
joining hour, so a room with very many players is spread over tasks. Joins carry no hints: the optimizer broadcasts
sides it has measured to be small and splits skewed ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gamify import answer_points, is_correct, podium_xp
from .ordered import banded_positions, positions

OPEN_STATUSES = ["waiting", "starting"]
LOBBY_ROWS = 10
OPTIONS = 4


def open_rooms(rooms: DataFrame) -> DataFrame:
    return rooms.where(F.col("status").isin(OPEN_STATUSES))


def newest_open(rooms: DataFrame, n: int = LOBBY_ROWS) -> DataFrame:
    return open_rooms(rooms).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def active(participants: DataFrame) -> DataFrame:
    return participants.where("is_active")


def room_players(participants: DataFrame) -> DataFrame:
    return participants.groupBy("room_id").agg(F.count_if("is_active").alias("player_count"))


def room_full(rooms: DataFrame, participants: DataFrame) -> DataFrame:
    """Rooms with their player count and whether no more may join."""
    counts = room_players(participants).withColumnRenamed("room_id", "id")
    players = F.coalesce("player_count", F.lit(0))
    return rooms.join(counts, "id", "left").select(
        F.col("id").alias("room_id"),
        "max_players",
        players.alias("player_count"),
        (players >= F.col("max_players")).alias("is_full"),
    )


def waiting_list(participants: DataFrame) -> DataFrame:
    """Active players of every room in joining order."""
    return _by_hour(
        active(participants), [("joined_hour", False)], [F.col("joined_at"), F.col("user_id")], "position"
    )


def _by_hour(rows: DataFrame, slices, order, name: str) -> DataFrame:
    sliced = rows.withColumn("joined_hour", F.date_trunc("hour", "joined_at"))
    return positions(sliced, ["room_id"], slices, order, name).drop("joined_hour")


def player_names(participants: DataFrame, users: DataFrame) -> DataFrame:
    return participants.join(users.select(F.col("id").alias("user_id"), "username"), "user_id")


def with_host(rooms: DataFrame, users: DataFrame) -> DataFrame:
    return rooms.join(users.select(F.col("id").alias("host_id"), F.col("username").alias("host")), "host_id")


def room_state(rooms: DataFrame, participants: DataFrame, users: DataFrame, scores: DataFrame) -> DataFrame:
    """Header of every room with one row per active player.

    A room without active players gives one row with empty player columns. The
    rows are left flat: a nested list would put all players of a room in one
    record.
    """
    players = with_scores(player_names(active(participants), users), scores).select(
        F.col("room_id").alias("id"), "username", "score", "correct_answers"
    )
    return (
        with_host(rooms, users)
        .select("id", "code", "topic", "status", "current_question", "num_questions", "host")
        .join(players, "id", "left")
    )


def with_key(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with the right option and whether they hit it."""
    key = questions.select("room_id", "question_number", "correct_answer")
    return answers.join(key, ["room_id", "question_number"]).withColumn(
        "is_correct", is_correct(F.col("selected_answer"), F.col("correct_answer"))
    )


def score_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with points; batch and streaming answers alike."""
    return with_key(answers, questions).withColumn(
        "points", answer_points(F.col("is_correct"), F.col("response_time"))
    )


def participant_scores(answers: DataFrame, questions: DataFrame) -> DataFrame:
    return score_answers(answers, questions).groupBy("room_id", "user_id").agg(
        F.sum("points").alias("score"), F.count_if("is_correct").alias("correct_answers")
    )


def with_scores(participants: DataFrame, scores: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return (
        participants.join(scores, ["room_id", "user_id"], "left")
        .withColumn("score", F.coalesce("score", zero))
        .withColumn("correct_answers", F.coalesce("correct_answers", zero))
    )


def current_answers(rooms: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers to the question each room is at."""
    at = rooms.select(F.col("id").alias("room_id"), F.col("current_question").alias("question_number"))
    return answers.join(at, ["room_id", "question_number"])


def all_answered(rooms: DataFrame, answers: DataFrame, participants: DataFrame) -> DataFrame:
    """Whether a room's current question has as many answers as active players.

    Answers of players who left still count.
    """
    given = current_answers(rooms, answers).groupBy("room_id").agg(F.count("*").alias("answered"))
    zero = F.lit(0).cast("long")
    answered, players = F.coalesce("answered", zero), F.coalesce("player_count", zero)
    return (
        rooms.select(F.col("id").alias("room_id"), "current_question", "num_questions")
        .join(given, "room_id", "left")
        .join(room_players(participants), "room_id", "left")
        .select(
            "room_id",
            "current_question",
            "num_questions",
            answered.alias("answered"),
            players.alias("players"),
            (answered >= players).alias("all_answered"),
        )
    )


def has_answered(new: DataFrame, answers: DataFrame) -> DataFrame:
    """New answers marked by whether the player answered that question before."""
    keys = ["room_id", "user_id", "question_number"]
    before = answers.select(*keys).distinct().withColumn("has_answered", F.lit(True))
    return new.join(before, keys, "left").withColumn(
        "has_answered", F.coalesce("has_answered", F.lit(False))
    )


def only_members(answers: DataFrame, participants: DataFrame) -> DataFrame:
    """Answers sent by active members of the room."""
    return answers.join(active(participants), ["room_id", "user_id"], "left_semi")


def answer_histogram(answers: DataFrame) -> DataFrame:
    """Answers per option of every question.

    ``stats`` counts an unanswered question (−1) as the last option, and is
    null when an answer lies outside −4..3. ``options`` and ``timeouts`` keep
    the two apart.
    """
    chosen = F.col("selected_answer")
    slot = F.pmod(chosen, F.lit(OPTIONS))
    wrapped = [F.count_if(slot == i) for i in range(OPTIONS)]
    plain = [F.count_if(chosen == i) for i in range(OPTIONS)]
    valid = F.bool_and(chosen.between(-OPTIONS, OPTIONS - 1))
    return answers.groupBy("room_id", "question_number").agg(
        F.when(valid, F.array(*wrapped)).alias("stats"),
        F.array(*plain).alias("options"),
        F.count_if(chosen == -1).alias("timeouts"),
    )


def leaderboard(participants: DataFrame, scores: DataFrame) -> DataFrame:
    """Active players by score, earlier joiners first among equals."""
    return ranked(with_scores(active(participants), scores))


def ranked(players: DataFrame) -> DataFrame:
    """Players with their scores, by place; the input is read several times."""
    # score and second of joining in one number, in the order of places
    top = F.lit(1 << 20)
    rough = (top - F.greatest(F.least(F.col("score"), top), -top)) * F.lit(1 << 32) + F.unix_seconds(F.col("joined_at").cast("timestamp"))
    order = [F.col("score").desc(), F.col("joined_at"), F.col("user_id")]
    return banded_positions(players, ["room_id"], rough, order).withColumn(
        "medal",
        F.when(F.col("position") == 1, "gold")
        .when(F.col("position") == 2, "silver")
        .when(F.col("position") == 3, "bronze"),
    )


def final_results(rooms: DataFrame, participants: DataFrame, scores: DataFrame) -> DataFrame:
    """Places, accuracy and bonus XP of the active players of every room."""
    return results(rooms, leaderboard(participants, scores))


def results(rooms: DataFrame, places: DataFrame) -> DataFrame:
    """Places (``ranked``) with accuracy and bonus XP."""
    size = rooms.select(F.col("id").alias("room_id"), "num_questions")
    return (
        places.join(size, "room_id")
        .select(
            "room_id",
            "user_id",
            F.col("position").alias("rank"),
            "score",
            "correct_answers",
            F.col("num_questions").alias("total_questions"),
            F.bround(F.col("correct_answers") / F.nullif("num_questions", F.lit(0)) * 100, 1).alias("accuracy"),
            podium_xp(F.col("position")).alias("bonus_xp"),
        )
    )


def resolve_users(logins: DataFrame, users: DataFrame) -> DataFrame:
    """Login text matched to e-mail or user name, ignoring case.

    Two equality joins instead of one OR condition. Where several users match,
    ``matches`` tells and ``user_id`` stays null.
    """
    wanted = logins.select("login").distinct().withColumn("key", F.lower("login"))
    found = None
    for name in ("email", "username"):
        hit = wanted.join(users.select(F.lower(name).alias("key"), F.col("id").alias("user_id")), "key")
        found = hit if found is None else found.union(hit)
    return (
        found.select("login", "user_id")
        .distinct()
        .groupBy("login")
        .agg(F.count("*").alias("matches"), F.min("user_id").alias("user_id"))
        .withColumn("user_id", F.when(F.col("matches") == 1, F.col("user_id")))
    )
