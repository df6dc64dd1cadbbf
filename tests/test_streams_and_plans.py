"""Steps of the streams with late and repeated rows, rounding, and plans without sorted aggregation."""

import datetime
import os
import random

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from studyloom.operators import exercises, sessions
from studyloom.session import shared_folder
from studyloom.sources import sinks as tables
from studyloom.streaming import ledger, live, sinks, state


def at(hours, seconds=0):
    return datetime.datetime(2024, 5, 1) + datetime.timedelta(hours=hours, seconds=seconds)


def replay(spark, frames, schema, build, mode="append"):
    """Let frames arrive one by one; gives what came out of each batch, and the checkpoint's folder."""
    root = shared_folder(spark, "test-stream")
    batches = []
    for i, frame in enumerate(frames):
        tables.append(spark.createDataFrame(frame, schema), f"{root}/in")
        sinks.write_batches(build(spark.readStream.schema(schema).parquet(f"{root}/in")), f"{root}/out", f"{root}/checkpoint", mode)
        batches.append([tuple(r) for r in spark.read.parquet(f"{root}/out/batch={i}").collect()])
    return batches, f"{root}/checkpoint"


def keys_left(spark, checkpoint, name):
    """Keys of a state variable after the last batch."""
    rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return sorted({tuple(r.key) for r in rows.collect()})


def test_sessions_of_any_length(spark):
    schema = "session_id long, user_id long, topic string, score double, start_time timestamp, end_time timestamp, kind string"
    frames = [
        [(1, 1, "a", None, at(0), None, "start"), (2, 1, "b", None, at(0), None, "start"), (9, 1, "x", 1.0, None, at(1), "end")],
        [(1, None, None, 5.0, None, at(13), "end"), (3, 2, "c", None, at(2), None, "start"), (4, None, None, 2.0, None, at(8), "end")],
        [(1, None, None, 7.0, None, at(20), "end"), (3, None, None, None, None, at(900), "end"), (4, None, None, 3.0, None, at(7), "end")],
        [(4, 3, "d", None, at(6), None, "start")],  # its two ends came before it
    ]
    out, checkpoint = replay(spark, frames, schema, live.pair_sessions)
    hour = 3600
    assert out == [[], [(1, 1, "a", 13 * hour, 5.0)], [(3, 2, "c", 898 * hour, None)], [(4, 3, "d", hour, 3.0)]]
    assert keys_left(spark, checkpoint, "start") == [(2,)]


def test_many_sessions_share_entries_of_state(spark):
    """An entry per session would cost a call to the store for each, whatever the size of a batch."""
    schema = "session_id long, user_id long, topic string, score double, start_time timestamp, end_time timestamp, kind string"
    n = 2 * state.BUCKETS + 100
    frames = [
        [(i << 20, 1, "a", None, at(0), None, "start") for i in range(n)],
        [(i << 20, None, None, 1.0, None, at(1), "end") for i in range(n)],
    ]
    out, checkpoint = replay(spark, frames[:1], schema, live.pair_sessions)
    # ids that differ in their high bits only are dealt over all buckets
    assert out == [[]] and state.BUCKETS // 2 < len(keys_left(spark, checkpoint, "start")) <= state.BUCKETS
    out, checkpoint = replay(spark, frames, schema, live.pair_sessions)
    assert sorted(x[0] for x in out[1]) == [i << 20 for i in range(n)] and keys_left(spark, checkpoint, "start") == []


ANSWERS = "kind string, room_id long, user_id long, question_number long, selected_answer int, response_time double, ts timestamp"


def answer(room, user, question, selected, ts, seconds=30.0):
    return ("answer", room, user, question, selected, seconds, ts)


def finished(room, ts):
    return ("finished", room, None, None, None, None, ts)


FRAMES = [
    [answer(1, 1, 1, 0, at(1)), answer(1, 1, 1, 2, at(0)), answer(2, 5, 1, 3, at(0))],
    [answer(1, 1, 1, 3, at(7)), answer(1, 2, 1, -1, at(-30)), answer(1, 1, 2, 2, at(3), 60.0), finished(2, at(8))],
    [answer(2, 5, 1, 1, at(9)), answer(2, 6, 1, 1, at(9)), answer(1, 2, 2, 2, at(10), 60.0), finished(1, at(11))],
]


def test_first_answers_until_the_room_ends(spark):
    out, checkpoint = replay(spark, FRAMES, ANSWERS, live.first_answers)
    got = [sorted(x[:4] for x in batch) for batch in out]
    assert got == [[(1, 1, 1, 2), (2, 5, 1, 3)], [(1, 1, 2, 2), (1, 2, 1, -1)], [(1, 2, 2, 2)]]
    assert keys_left(spark, checkpoint, "answered") == []


def test_totals_after_every_batch(spark):
    questions = spark.createDataFrame([(r, q, 2) for r in (1, 2) for q in (1, 2)], "room_id long, question_number long, correct_answer int")
    out, checkpoint = replay(spark, FRAMES, ANSWERS, lambda s: live.live_totals(s, questions), "update")
    assert [sorted(x) for x in out] == [[(1, 1, 1250, 1), (2, 5, 0, 0)], [(1, 1, 2250, 2), (1, 2, 0, 0)], [(1, 2, 1000, 1)]]
    assert keys_left(spark, checkpoint, "totals") == []


def test_histogram_after_every_batch(spark):
    out, checkpoint = replay(spark, FRAMES, ANSWERS, live.live_histogram, "update")
    assert [sorted(x) for x in out] == [
        [(1, 1, 1, 0, 1, 0, 0), (2, 1, 0, 0, 0, 1, 0)],
        [(1, 1, 1, 0, 1, 2, 1), (1, 2, 0, 0, 1, 0, 0)],
        [(1, 2, 0, 0, 2, 0, 0)],
    ]
    assert keys_left(spark, checkpoint, "counts") == []


@pytest.mark.parametrize("end_rule, end", [("stay", 3), ("pass", 4)])
def test_a_player_who_leaves_moves_the_room_on(spark, end_rule, end):
    schema = "kind string, room_id long, user_id long, question_number long, ts timestamp, id long"

    def player(kind, user, ts):
        return (kind, 1, user, None, ts, 0)

    def said(user, question):
        return ("answer", 1, user, question, at(5), user)

    frames = [
        [player("connect", u, at(0)) for u in (1, 2, 3)] + [said(1, 1)],
        [said(2, 1), said(1, 1), said(1, 2)],
        [player("disconnect", 3, at(2)), player("connect", 3, at(1))],  # the later event counts, whatever comes first
        [said(2, 2), player("disconnect", 1, at(9))],
        [player("connect", 4, at(10)), said(2, 3)],
        [said(1, 3)],  # of a player who left: it still counts
    ]
    rooms = spark.createDataFrame([(1, 3)], "id long, num_questions long")
    root, stands = shared_folder(spark, "test-barrier"), []
    for i, frame in enumerate(frames):
        tables.append(spark.createDataFrame(frame, schema), f"{root}/in")
        rows = spark.readStream.schema(schema).parquet(f"{root}/in")
        sinks.write_log(live.attendance(rows), f"{root}/changes", f"{root}/changes-checkpoint")
        changes = spark.readStream.schema(state.CHANGE).parquet(f"{root}/changes")
        sinks.write_batches(live.room_progress(changes, rooms, end_rule), f"{root}/out", f"{root}/checkpoint", "update")
        stands.append([(r.current_question, r.status) for r in spark.read.parquet(f"{root}/out/batch={i}").collect()])
    assert stands == [[(1, "in_progress")], [(1, "in_progress")], [(2, "in_progress")], [(3, "in_progress")], [(3, "in_progress")], [(end, "finished")]]


@pytest.mark.parametrize("first_limit", [None, 30])
def test_answers_and_questions_in_any_order(spark, first_limit):
    schema = "kind string, room_id long, user_id long, question_number long, selected_answer int, response_time double, asked_at timestamp, ts timestamp"

    def asked(user, question=1):
        return ("asked", 1, user, question, None, None, at(0), None)

    def gave(user, selected, seconds):
        return ("answer", 1, user, 1, selected, float(seconds), None, at(0, seconds))

    def closed(user):
        return ("closed", 1, user, 1, None, None, None, None)

    frames = [
        [asked(1), asked(2), asked(3), asked(4), gave(5, 2, 10), closed(6)],
        [asked(9, 2), gave(2, 3, 70), gave(2, 1, 80), asked(5), asked(6)],
        [gave(1, 2, 20), gave(4, 1, 40), gave(1, 3, 50), gave(5, 3, 11)],
        [closed(u) for u in (1, 2, 3, 4, 5)],
    ]
    out, checkpoint = replay(spark, frames, schema, lambda rows: live.with_timeouts(rows, 60, first_limit))
    limit = float(first_limit or 60)
    fourth = (1, 40.0) if first_limit is None else (-1, 30.0)
    got = [{r[1]: r[3:] for r in batch} for batch in out]
    assert got == [{}, {2: (-1, limit), 5: (2, 10.0), 6: (-1, limit)}, {1: (2, 20.0), 4: fourth}, {3: (-1, limit)}]
    assert [k[1] for k in keys_left(spark, checkpoint, "asked")] == [9]


def test_results_enter_the_ledger_as_rooms_end(spark):
    questions = spark.createDataFrame([(r, q, 2) for r in (1, 2) for q in (1, 2)], "room_id long, question_number long, correct_answer int")
    rooms = spark.createDataFrame([(1, 2), (2, 2)], "id long, num_questions int")
    people = spark.createDataFrame(
        [(1, 1, at(0), True), (1, 2, at(0), True), (1, 3, at(0), False), (2, 5, at(0), True), (2, 1, at(1), True)],
        "room_id long, user_id long, joined_at timestamp, is_active boolean",
    )
    root = shared_folder(spark, "test-results")
    accounts, results = [], []
    for i, frame in enumerate(FRAMES):
        tables.append(spark.createDataFrame(frame, ANSWERS), f"{root}/in")
        totals = live.totals_at_end(spark.readStream.schema(ANSWERS).parquet(f"{root}/in"), questions)
        sinks.write_steps(
            totals, f"{root}/out", f"{root}/checkpoint", ledger.live_awards, ledger.ACCOUNTS, "user_id",
            lambda rows: ledger.result_events(live.finish_rooms(rows, rooms, people)),
        )
        accounts.append({r.user_id: r.total for r in sinks.read_state(spark, f"{root}/out", i, ledger.ACCOUNTS).collect()})
        results.append(sorted((r.room_id, r.user_id, r["rank"], r.score, r.total_xp) for r in spark.read.parquet(f"{root}/out/batch={i}").collect()))
    assert results == [[], [(2, 1, 2, 0, 40), (2, 5, 1, 0, 50)], [(1, 1, 1, 2250, 90), (1, 2, 2, 1000, 40)]]
    assert accounts == [{}, {1: 40, 5: 50}, {1: 90, 2: 40, 5: 50}]


def test_a_batch_writes_the_buckets_it_touches(spark):
    schema = "activity_id long, user_id long, ts timestamp, activity_type string, difficulty string, score double"
    frames = [
        [(u, u, at(0), "course_save", None, None) for u in range(200)], [(1000, 7, at(1), "course_save", None, None)],
        [(1001, 7, at(2), "course_save", None, None)], [(1002, 8, at(3), "course_save", None, None)],
    ]
    root = shared_folder(spark, "test-buckets")
    for i, frame in enumerate(frames):
        tables.append(spark.createDataFrame(frame, schema), f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        sinks.write_steps(stream, f"{root}/out", f"{root}/checkpoint", ledger.live_ledger, ledger.ACCOUNTS, "user_id", buckets=16)
        written = {p for p in os.listdir(f"{root}/out-state/batch={i}") if p.startswith("bucket=")}
        assert len(written) == (16 if i == 0 else 1)
    totals = {r.user_id: r.total for r in sinks.read_state(spark, f"{root}/out", 3, ledger.ACCOUNTS).collect()}
    assert totals == {u: 30 if u == 7 else 20 if u == 8 else 10 for u in range(200)}
    # versions that were replaced twice are gone
    assert not {p for p in os.listdir(f"{root}/out-state/batch=1") if p.startswith("bucket=")}


def test_ties_round_to_even(spark):
    row = spark.range(1).select(exercises.success_rate(F.lit(16), F.lit(1)).alias("x"), exercises.success_rate(F.lit(16), F.lit(3)).alias("y")).first()
    assert (row.x, row.y) == (6.2, 18.8)
    df = spark.createDataFrame([(1, "quiz", 84.9499999, 1)], "user_id long, activity_type string, score double, duration_seconds int")
    assert sessions.user_stats(df).first().average_score == 84.9


@pytest.mark.parametrize("name", ["learner_levels", "win_xp_ledger", "agg_exercise_progress"])
def test_no_sorted_aggregation(spark, name):
    rows = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()


def test_texts_are_cut_once(spark):
    from studyloom.operators import corpus

    pages = spark.createDataFrame([("/d/a.md", 0, "x y " * 900)], "path string, page int, text string")
    plan = corpus.chunk_lists(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_live_ledger_with_a_hot_user(spark):
    """A user with a third of all rows, quiet days, rows of earlier days: batch by batch as row by row."""
    rng = random.Random(11)
    kinds = ["course_save", "exercise_completion", "quiz_completion"]
    schema = "activity_id long, user_id long, ts timestamp, activity_type string, difficulty string, score double"
    days = [(0, 3), (3, 4), (6, 8), (2, 9)]  # the last frame goes back in time
    frames = [
        [
            (1000 * f + i, 1 if i % 3 == 0 else rng.randrange(2, 30), at(rng.randrange(24 * a, 24 * b), rng.randrange(3600)),
             rng.choice(kinds), "beginner", float(rng.randrange(100)))
            for i in range(300)
        ]
        for f, (a, b) in enumerate(days)
    ]
    held, want = {}, {}
    for frame in frames:
        for i, user, ts, kind, _, score in sorted(frame, key=lambda r: (r[2], r[0])):
            total, before, last = held.get(user, (0, 0, None))
            gap = None if last is None else (ts.date() - last).days
            streak = 1 if gap is None or gap > 1 else before + max(gap, 0)
            gained = {"course_save": 10, "exercise_completion": 20}.get(kind, 10 + int(score / 10) + min(2 * before, 20))
            held[user] = (total + gained, streak, ts.date() if last is None else max(last, ts.date()))
            want[i] = (user, streak, before, gained, total + gained)
    root = shared_folder(spark, "test-ledger")
    for frame in frames:
        tables.append(spark.createDataFrame(frame, schema), f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        sinks.write_steps(stream, f"{root}/out", f"{root}/checkpoint", ledger.live_ledger, ledger.ACCOUNTS, "user_id")
    out = spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out").drop("batch")
    accounts = sinks.read_state(spark, f"{root}/out", len(frames) - 1, ledger.ACCOUNTS)
    got = {r.activity_id: (r.user_id, r.streak, r.streak_before, r.xp_gained, r.total_xp) for r in out.collect()}
    assert out.count() == len(got) and got == want
    assert {r.user_id: (r.total, r.streak, r.day) for r in accounts.collect()} == held
    # the log is dealt by user and hour, and no Python sees it
    step, *_ = ledger.live_ledger(spark.createDataFrame(frames[0], schema).cache(), spark.createDataFrame([], ledger.ACCOUNTS))
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_modules_of_all_name_lengths_are_joined(spark):
    rows = entry.queries()["join_module_name_whole"](spark, "/root/testdata/sf0.001").select("module", "module_name").distinct().collect()
    names = {r.module: r.module_name for r in rows}
    assert {len(m) for m in names} == {4, 5}
    assert all(name == f"Name of 01_{m}" for m, name in names.items() if m != "src0")
