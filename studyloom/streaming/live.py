"""The live quiz flow on streaming DataFrames.

What must be remembered between batches lies in the state store (``state``); it
goes when the session, question or room ends, and no length of time decides
what counts. Results come after every batch.

``answers``: kind ("answer", and "finished" rows without a user for rooms that
end), room_id, user_id, question_number, selected_answer, response_time, ts.
``presence``: id, room_id, user_id, kind (connect/disconnect), ts.
``lifecycle``: room_id, kind, ts. Every operator has a batch twin with the same
result; most are the batch operator itself. Event times must be ``timestamp``:
streams do not take ``timestamp_ntz``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gamify import answer_points, is_correct
from ..operators import rooms as batch
from . import state

ANSWER_LIMIT_SECONDS = 60
SOLO_FIRST_LIMIT_SECONDS = 30
LIFECYCLE = ["waiting", "starting", "in_progress", "finished"]


def first_answers(rows: DataFrame) -> DataFrame:
    """First answer per player and question, as it comes (append mode).

    Within a batch the earliest answer is the first. After a room's end nothing counts.
    """
    return state.answers(rows, "answers")


def scored_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with points; a stream joined with the question table."""
    return batch.score_answers(answers, questions)


def _scored(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with points, ended rooms as they are."""
    key = questions.select("room_id", "question_number", "correct_answer")
    hit = is_correct(F.col("selected_answer"), F.col("correct_answer"))
    return (
        rows.join(key, ["room_id", "question_number"], "left")
        .where("kind = 'finished' OR correct_answer IS NOT NULL")
        .withColumns({"is_correct": hit, "points": answer_points(hit, F.col("response_time"))})
    )


def live_totals(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Score and number of correct answers of the players who gave a first answer (update mode)."""
    return state.answers(_scored(rows, questions), "totals")


def totals_at_end(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Totals of all players of the rooms that end, and a row without a player for each of those rooms (append mode)."""
    return state.answers(_scored(rows, questions), "results")


def live_histogram(rows: DataFrame) -> DataFrame:
    """Answers per option of the questions that were answered (update mode).

    Counted before the shuffle as well, so one busy room is no bottleneck.
    """
    return state.histogram(rows)


def presence(events: DataFrame) -> DataFrame:
    """Whether each player is in the room, by the latest event (update mode).

    One row of state for a player, as in the table of players.
    """
    return (
        events.groupBy("room_id", "user_id")
        .agg(F.max(F.struct("ts", "id", "kind")).alias("last"))
        .select("room_id", "user_id", (F.col("last.kind") == "connect").alias("is_active"))
    )


def attendance(rows: DataFrame) -> DataFrame:
    """What changes in a room: players present and first answers per question (append mode).

    ``rows`` holds answers and presence events, and rooms that end. A log of
    this (``sinks.write_log``) is what :func:`room_progress` reads.
    """
    return state.attendance(rows)


def room_progress(changes: DataFrame, rooms: DataFrame, end_rule: str = "stay") -> DataFrame:
    """Where each room stands: it moves on when as many have answered as are present (update mode).

    At the end ``end_rule`` "stay" keeps a room at the last question, "pass"
    moves it one past.
    """
    return state.barrier(changes, rooms, end_rule)


def with_timeouts(rows: DataFrame, limit_seconds: int = ANSWER_LIMIT_SECONDS, first_limit_seconds: int | None = None) -> DataFrame:
    """Answers, and a "no answer" row for every question a player let pass (append mode).

    ``rows`` holds, by kind, "asked" questions with the time they were shown
    (``asked_at``), "answer" rows and "closed" questions, in any order. An
    answer decides its question whenever it arrives; one given after the limit
    is "no answer". A question without an answer is decided when it is closed.
    ``first_limit_seconds`` is another limit for a player's first question, as
    in the game of one.
    """
    return state.questions(rows, limit_seconds, first_limit_seconds)


def room_status(lifecycle: DataFrame) -> DataFrame:
    """Status and times of every room from its lifecycle events (update mode).

    One row of state for a room, as in the table of rooms. The status is the furthest one reached; a room may skip "starting".
    """
    reached = F.max(F.array_position(F.array(*[F.lit(s) for s in LIFECYCLE]), F.col("kind")))
    at = [
        F.min(F.when(F.col("kind") == kind, F.col("ts"))).alias(name)
        for kind, name in (("waiting", "created_at"), ("in_progress", "started_at"), ("finished", "finished_at"))
    ]
    return (
        lifecycle.groupBy("room_id")
        .agg(reached.alias("reached"), *at)
        .withColumn("status", F.element_at(F.array(*[F.lit(s) for s in LIFECYCLE]), F.col("reached").cast("int")))
        .drop("reached")
    )


def finish_rooms(totals: DataFrame, rooms: DataFrame, participants: DataFrame) -> DataFrame:
    """Final results of the rooms that end in a batch, from their totals (:func:`totals_at_end`).

    Each row is also one XP event of type multiplayer_quiz: rank, bonus_xp and ended_at.
    """
    ended = totals.groupBy("room_id").agg(F.max("ended_at").alias("ended_at"))
    results = batch.final_results(
        rooms.join(ended.select(F.col("room_id").alias("id")), "id", "left_semi"),
        participants.join(ended, "room_id", "left_semi"),
        totals.where("user_id IS NOT NULL").drop("ended_at"),
    )
    return results.join(ended, "room_id")


def pair_sessions(rows: DataFrame) -> DataFrame:
    """Sessions that end, with their duration (append mode).

    ``rows`` holds starts (kind "start") and ends, in any order. The earliest
    end of a session counts.
    """
    return state.sessions(rows)
