"""Streams replayed from the tables, checked against their batch twins."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import sinks as tables
from ..streaming import ledger, live, sinks, state
from .activity import LEDGER_SQL
from .registry import query, table, view
from .rooms import FINAL_SQL, SCORED_SQL


def _replay(spark, frames, build, label, mode="append", each=None):
    """Let the frames arrive one after the other, and run the stream after each.

    The stream stops in between and goes on from its checkpoint. Returns the
    written batches.
    """
    root = shared_folder(spark, label)
    schema = frames[0].schema
    for frame in frames:
        tables.append(frame, f"{root}/in")
        stream = build(spark.readStream.schema(schema).parquet(f"{root}/in"))
        sinks.write_batches(stream, f"{root}/out", f"{root}/checkpoint", mode, each)
    return spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out")


def _answer_frames(spark, folder):
    """The log of answers with all its repeats, over three frames by time.

    Rooms finish after the last frame, and everything that was said comes once
    more after that: none of it may count.
    """
    log = _answer_log(spark, folder)
    return [*_by_order(log), _finished(log), log]


def _answer_log(spark, folder):
    return view(spark, folder, "fx_answer_log").select(
        F.lit("answer").alias("kind"), F.col("room_id").cast("long").alias("room_id"), F.col("user_id").cast("long").alias("user_id"),
        F.col("question_number").cast("long").alias("question_number"), "selected_answer", "response_time", F.col("id").alias("answer_id"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def _finished(log):
    """The end of every room, in the shape of its answers."""
    ended = log.groupBy("room_id").agg(F.max("ts").alias("ts"))
    others = {c: F.lit(None).cast(t).alias(c) for c, t in log.dtypes}
    return ended.select(*[F.col(c) if c in ended.columns else others[c] for c in log.columns]).withColumn("kind", F.lit("finished"))


def _by_order(log):
    """A log cut by time (``ts``) into three frames."""
    second = F.unix_seconds("ts")
    low, high = log.agg(F.min(second), F.max(second)).first()
    cut = [low + (high - low) // 3, low + 2 * (high - low) // 3]
    return [log.where(second <= cut[0]), log.where((second > cut[0]) & (second <= cut[1])), log.where(second > cut[1])]


@query(
    "stream_answer_dedup",
    "SELECT room_id, user_id, question_number, selected_answer, response_time FROM <fx_answers> a",
)
def stream_answer_dedup(spark, folder):
    return _replay(spark, _answer_frames(spark, folder), live.first_answers, "dedup").drop("batch")


@query(
    "stream_answer_scoring",
    f"WITH {SCORED_SQL.replace('<fx_answers>', '<fx_answer_log>')} SELECT room_id, user_id, question_number, is_correct, points FROM scored",
)
def stream_answer_scoring(spark, folder):
    """Every answer of the log, repeats too, as it arrives."""
    questions = view(spark, folder, "fx_questions")
    frames = _answer_frames(spark, folder)[:3]
    out = _replay(spark, frames, lambda s: live.scored_answers(s, questions), "scoring")
    return out.select("room_id", "user_id", "question_number", "is_correct", "points")


@query("stream_participant_totals", f"WITH {SCORED_SQL} SELECT * FROM scores")
def stream_participant_totals(spark, folder):
    """Totals over first answers only, after every batch; repeats arrive and change nothing."""
    questions = view(spark, folder, "fx_questions")
    out = _replay(spark, _answer_frames(spark, folder), lambda s: live.live_totals(s, questions), "totals", "update")
    return sinks.latest(out, ["room_id", "user_id"])


@query(
    "stream_answer_histogram",
    """SELECT room_id, question_number, count(*) FILTER (WHERE selected_answer = 0) AS a, count(*) FILTER (WHERE selected_answer = 1) AS b,
    count(*) FILTER (WHERE selected_answer = 2) AS c, count(*) FILTER (WHERE selected_answer IN (3, -1)) AS d, count(*) FILTER (WHERE selected_answer = -1) AS timeouts
    FROM <fx_answer_log> s GROUP BY room_id, question_number""",
)
def stream_answer_histogram(spark, folder):
    """Counts of all that is said until a room ends, after every batch."""
    out = _replay(spark, _answer_frames(spark, folder), live.live_histogram, "histogram", "update")
    return sinks.latest(out, ["room_id", "question_number"])


@query(
    "stream_presence",
    """SELECT user_id % 10 AS room_id, user_id, max_by(event_type, row(ts, event_id)) <> 'error' AS is_active FROM events GROUP BY user_id""",
)
def stream_presence(spark, folder):
    events = table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 10).alias("room_id"),
        "user_id",
        F.when(F.col("event_type") == "error", "disconnect").otherwise("connect").alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    early = F.dayofmonth("ts") <= 15
    out = _replay(spark, [events.where(early), events.where(~early)], live.presence, "presence", "update")
    return sinks.latest(out, ["room_id", "user_id"])


_BARRIER_SQL = """WITH players AS (SELECT room_id, count(*) FILTER (WHERE is_active) AS n FROM <fx_participants> p GROUP BY room_id),
    done AS (SELECT a.room_id, a.question_number FROM <fx_answers> a JOIN players p ON p.room_id = a.room_id GROUP BY a.room_id, a.question_number, p.n HAVING count(*) >= p.n),
    run AS (SELECT room_id, count(*) FILTER (WHERE question_number = rn) AS passed FROM (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY question_number) AS rn FROM done) t GROUP BY room_id)
    SELECT r.id AS room_id, least(coalesce(passed, 0) + 1, num_questions{past}) AS current_question, CASE WHEN coalesce(passed, 0) >= num_questions THEN 'finished' ELSE 'in_progress' END AS status
    FROM <fx_rooms> r LEFT JOIN run ON run.room_id = r.id"""


def _barrier(spark, folder, end_rule):
    """Answers and presence to changes per room, and those to where each room stands.

    All players come first; those who are not active in the end leave in the
    middle of the answers, which completes questions that others had answered.
    First answers only count; repeats arrive and are dropped on the way.
    """
    log = _answer_log(spark, folder).withColumnRenamed("answer_id", "id")
    people = view(spark, folder, "fx_participants").select(
        F.col("room_id").cast("long").alias("room_id"), F.col("user_id").cast("long").alias("user_id"),
        F.col("joined_at").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("id"), "is_active",
    )
    nothing = [F.lit(None).cast(t).alias(c) for c, t in log.dtypes if c in ("question_number", "selected_answer", "response_time")]
    come = people.select(F.lit("connect").alias("kind"), "room_id", "user_id", "ts", "id", *nothing)
    go = people.where("NOT is_active").select(
        F.lit("disconnect").alias("kind"), "room_id", "user_id", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), "id", *nothing
    )
    early, middle, late = _by_order(log)
    frames = [come.unionByName(early), middle, go.unionByName(late), _finished(log), log]
    all_rooms = view(spark, folder, "fx_rooms")
    root = shared_folder(spark, "barrier")
    for frame in frames:
        tables.append(frame.select(log.columns), f"{root}/in")
        rows = spark.readStream.schema(log.schema).parquet(f"{root}/in")
        sinks.write_log(live.attendance(rows), f"{root}/changes", f"{root}/changes-checkpoint")
        changes = spark.readStream.schema(state.CHANGE).parquet(f"{root}/changes")
        sinks.write_batches(live.room_progress(changes, all_rooms, end_rule), f"{root}/out", f"{root}/checkpoint", "update")
    out = spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out")
    stands = sinks.latest(out, ["room_id"])
    return all_rooms.select(F.col("id").cast("long").alias("room_id")).join(stands, "room_id", "left").select(
        "room_id", F.coalesce("current_question", F.lit(1).cast("long")).alias("current_question"), F.coalesce("status", F.lit("in_progress")).alias("status")
    )


@query("stream_question_barrier", _BARRIER_SQL.format(past=""))
def stream_question_barrier(spark, folder):
    return _barrier(spark, folder, "stay")


@query("stream_question_barrier_pass", _BARRIER_SQL.format(past=" + 1"))
def stream_question_barrier_pass(spark, folder):
    """The other rule for the end: the room goes one past its last question."""
    return _barrier(spark, folder, "pass")


_ASKED_SQL = """asked AS (SELECT event_id, user_id % 10 AS room_id, user_id, event_id AS question_number, ts AS asked_at, value AS response_time, CAST(event_id % 4 AS INT) AS selected_answer FROM events)"""


def _asked_frames(spark, folder, number):
    """Every event asks its user a question, answered after ``value`` seconds.

    Questions with an answer on time and the others come by time, but every
    fifth is announced only after the answers of its time are there. Answers of
    every seventh question arrive at the very end, and those of every eleventh
    never do. All questions are closed last, some before they are announced.
    """
    seconds = F.expr("make_dt_interval(0, 0, 0, CAST(value AS DECIMAL(18, 6)))")
    events = table(spark, folder, "events").select(
        (F.col("user_id") % 10).cast("long").alias("room_id"), F.col("user_id").cast("long").alias("user_id"),
        number.cast("long").alias("question_number"), "event_id", (F.col("event_id") % 4).cast("int").alias("selected_answer"),
        F.col("value").alias("response_time"), F.col("ts").cast("timestamp").alias("asked_at"),
        (F.col("ts").cast("timestamp") + seconds).alias("ts"),
    )
    kinds = F.explode(F.array(F.lit("asked"), F.lit("answer"), F.lit("closed")))
    log = events.withColumn("kind", kinds).where("kind <> 'answer' OR event_id % 11 <> 0")
    held_back = (F.col("kind") == "answer") & (F.col("event_id") % 7 == 0)
    unannounced = (F.col("kind") == "asked") & (F.col("event_id") % 5 == 0)
    late = unannounced & (F.col("event_id") % 10 == 0)
    first = log.where((F.col("kind") != "closed") & ~held_back & ~unannounced)
    return [*_by_order(first), log.where(held_back | unannounced & ~late), log.where("kind = 'closed'"), log.where(late)]


_TIMED = "CASE WHEN response_time <= {limit} AND event_id % 11 <> 0 THEN {value} ELSE {other} END"


@query(
    "stream_question_timeout",
    f"""WITH {_ASKED_SQL} SELECT room_id, user_id, question_number, {_TIMED.format(limit=60, value='selected_answer', other=-1)} AS selected_answer,
    {_TIMED.format(limit=60, value='response_time', other=60)} AS response_time FROM asked""",
)
def stream_question_timeout(spark, folder):
    return _replay(spark, _asked_frames(spark, folder, F.col("event_id")), live.with_timeouts, "timeouts").drop("batch")


_SOLO = "CASE WHEN question_number = 1 THEN 30 ELSE 60 END"
_SOLO_SQL = _ASKED_SQL.replace("event_id AS question_number", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS question_number")


@query(
    "stream_question_timeout_solo",
    f"""WITH {_SOLO_SQL} SELECT room_id, user_id, question_number, {_TIMED.format(limit=_SOLO, value='selected_answer', other=-1)} AS selected_answer,
    {_TIMED.format(limit=_SOLO, value='response_time', other=_SOLO)} AS response_time FROM asked""",
)
def stream_question_timeout_solo(spark, folder):
    """The game of one: 30 seconds for the first question, 60 for the others."""
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    solo = functools.partial(live.with_timeouts, first_limit_seconds=live.SOLO_FIRST_LIMIT_SECONDS)
    return _replay(spark, _asked_frames(spark, folder, number), solo, "solo").drop("batch")


@query(
    "stream_room_lifecycle",
    """WITH l AS (SELECT user_id AS room_id, CASE event_type WHEN 'signup' THEN 'waiting' WHEN 'view' THEN 'starting' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'finished' ELSE 'waiting' END AS kind, ts FROM events)
    SELECT room_id, min(ts) FILTER (WHERE kind = 'waiting') AS created_at, min(ts) FILTER (WHERE kind = 'in_progress') AS started_at, min(ts) FILTER (WHERE kind = 'finished') AS finished_at,
      CASE max(CASE kind WHEN 'waiting' THEN 1 WHEN 'starting' THEN 2 WHEN 'in_progress' THEN 3 ELSE 4 END) WHEN 1 THEN 'waiting' WHEN 2 THEN 'starting' WHEN 3 THEN 'in_progress' ELSE 'finished' END AS status
    FROM l GROUP BY room_id""",
)
def stream_room_lifecycle(spark, folder):
    kind = F.expr(
        "CASE event_type WHEN 'signup' THEN 'waiting' WHEN 'view' THEN 'starting' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'finished' ELSE 'waiting' END"
    )
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("room_id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts")
    )
    early = F.dayofmonth("ts") <= 15
    out = _replay(spark, [events.where(early), events.where(~early)], live.room_status, "lifecycle", "update")
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "started_at", "finished_at")]
    return sinks.latest(out, ["room_id"]).select("room_id", "status", *times)


_ENDED_SQL = f"SELECT * FROM ({FINAL_SQL}) f WHERE room_id IN (SELECT id FROM <fx_rooms> r WHERE status = 'finished')"


def _final_results(spark, folder):
    """Folder of a stream of answers and ended rooms: results of each room as it ends, and the accounts they lead to.

    Answers come in three frames. Half of the finished rooms end in the fourth
    and half in the fifth, which also repeats every answer.
    """
    all_rooms, participants = view(spark, folder, "fx_rooms"), view(spark, folder, "fx_participants")
    questions = view(spark, folder, "fx_questions")
    log = _answer_log(spark, folder)
    over = _finished(log).join(all_rooms.where("status = 'finished'").select(F.col("id").alias("room_id")), "room_id", "left_semi")
    even = F.col("room_id") % 4 == 1
    frames = [*_by_order(log), over.where(even), over.where(~even).select(log.columns).unionByName(log)]
    root = shared_folder(spark, "results")
    for frame in frames:
        tables.append(frame.select(log.columns), f"{root}/in")
        totals = live.totals_at_end(spark.readStream.schema(log.schema).parquet(f"{root}/in"), questions)
        sinks.write_steps(
            totals, f"{root}/out", f"{root}/checkpoint", ledger.live_awards, ledger.ACCOUNTS, "user_id",
            lambda rows: ledger.result_events(live.finish_rooms(rows, all_rooms, participants)),
        )
    return f"{root}/out", len(frames)


@query("stream_final_results", _ENDED_SQL)
def stream_final_results(spark, folder):
    out, _ = _final_results(spark, folder)
    # batches in which no room ends write no rows
    rows = spark.read.option("basePath", out).parquet(out)
    names = ["room_id", "user_id", "rank", "score", "correct_answers", "total_questions", "accuracy", "bonus_xp"]
    return rows.select(names)


@query("stream_final_xp", f"SELECT user_id, CAST(sum(bonus_xp) AS BIGINT) AS total FROM ({_ENDED_SQL}) x GROUP BY user_id")
def stream_final_xp(spark, folder):
    """Accounts after the rooms have ended: the results are XP events of the ledger."""
    out, frames = _final_results(spark, folder)
    return sinks.read_state(spark, out, frames - 1, ledger.ACCOUNTS).select("user_id", "total")


@query(
    "stream_session_pairing",
    """SELECT id AS session_id, user_id, topic, CAST(duration_seconds + CASE WHEN id % 5 = 0 THEN 90000 ELSE 0 END AS INT) AS duration_seconds, score
    FROM <fx_sessions> s WHERE id % 13 <> 0""",
)
def stream_session_pairing(spark, folder):
    """Session starts and ends as one log over three frames; ends of unknown sessions are mixed in.

    Every fifth session lasts more than a day, every thirteenth never ends,
    and every session is ended a second time later on. The frames of every
    fourth session come in reverse, so its ends arrive before its start.
    """
    started = view(spark, folder, "fx_sessions").select(
        F.col("id").cast("long").alias("session_id"), F.col("user_id").cast("long").alias("user_id"), "topic", "score",
        F.col("start_time").cast("timestamp").alias("start_time"),
        (F.col("duration_seconds") + F.when(F.col("id") % 5 == 0, 90000).otherwise(0)).alias("seconds"),
    )
    ended = F.col("start_time") + F.expr("make_dt_interval(0, 0, 0, seconds)")
    again = ended + F.expr("INTERVAL 2 HOURS")
    kinds = F.explode(F.array(
        F.struct(F.lit("start").alias("kind"), F.col("start_time").alias("ts")), F.struct(F.lit("end").alias("kind"), ended.alias("ts")),
        F.struct(F.lit("end").alias("kind"), again.alias("ts")), F.struct(F.lit("lost").alias("kind"), ended.alias("ts")),
    ))
    log = started.select("*", kinds.alias("k")).select(
        F.when(F.col("k.kind") == "lost", -1 - F.col("session_id")).otherwise(F.col("session_id")).alias("session_id"),
        "user_id", "topic", "score", "start_time", F.col("k.ts").alias("end_time"), F.col("k.kind").alias("kind"), F.col("k.ts").alias("ts"),
    ).where("kind = 'start' OR session_id % 13 <> 0")
    turned = (F.col("session_id") % 4 == 0) & (F.col("session_id") >= 0)
    frames = [a.where(~turned).union(b.where(turned)) for a, b in zip(_by_order(log), reversed(_by_order(log)))]
    return _replay(spark, frames, live.pair_sessions, "pairing").drop("batch")


@query(
    "stream_xp_ledger",
    f"{LEDGER_SQL} SELECT activity_id, user_id, streak, streak_before, xp_gained, total_xp, old_level, new_level, new_level > old_level AS level_up FROM levels",
)
def stream_xp_ledger(spark, folder):
    log = view(spark, folder, "fx_activity").withColumn("ts", F.col("ts").cast("timestamp"))
    early = F.dayofmonth("ts") <= 15
    root = shared_folder(spark, "ledger")
    for frame in [log.where(early), log.where(~early)]:
        tables.append(frame, f"{root}/in")
        stream = spark.readStream.schema(log.schema).parquet(f"{root}/in")
        sinks.write_steps(stream, f"{root}/out", f"{root}/checkpoint", ledger.live_ledger, ledger.ACCOUNTS, "user_id")
    return spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out").drop("batch")
