"""Edge cases of the operators, and hot keys against a plain replay."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from studyloom.operators import activity, codecheck, corpus, exercises, generated, markdown, ordered, quiztext, rooms, sessions
from studyloom.sources import sinks


def day(n, hour=8, minute=0, second=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n - 1, hours=hour, minutes=minute, seconds=second)


def test_streaks(spark):
    rows = [(i, 1, day(d, 8, i), "course_save", None, None) for i, d in enumerate([1, 1, 2, 3, 5, 6])]
    log = spark.createDataFrame(rows, "activity_id long, user_id long, ts timestamp_ntz, activity_type string, difficulty string, score double")
    got = [r["streak"] for r in activity.with_streaks(log).orderBy("activity_id").collect()]
    assert got == [1, 1, 2, 3, 1, 2]


def random_activity(rows, hot_share, seed):
    rng = random.Random(seed)
    kinds = ["course_generation", "course_save", "exercise_completion", "quiz_completion"]
    out = []
    for i in range(rows):
        user = 1 if rng.random() < hot_share else rng.randrange(2, 40)
        kind = rng.choice(kinds)
        when = day(rng.randrange(1, 40), rng.randrange(24), rng.randrange(60), rng.randrange(3))
        out.append((i, user, when, kind, rng.choice(["advanced", "beginner"]), round(rng.uniform(0, 100), 1)))
    return out


def replay(rows):
    """Row by row, as one user after the other would see it."""
    totals, streaks, last, out = {}, {}, {}, {}
    for i, user, when, kind, difficulty, score in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        before = streaks.get(user, 0)
        gained = {
            "course_generation": 15,
            "course_save": 10,
            "exercise_completion": 30 if difficulty == "advanced" else 20,
            "quiz_completion": 10 + int(score / 10) + min(2 * before, 20),
        }[kind]
        today = when.date()
        if user not in last or (today - last[user]).days > 1:
            streaks[user] = 1
        elif (today - last[user]).days == 1:
            streaks[user] += 1
        last[user] = today
        totals[user] = totals.get(user, 0) + gained
        out[i] = (streaks[user], before, gained, totals[user])
    return out, totals, streaks


def test_ledger_with_a_hot_user(spark):
    rows = random_activity(3000, 0.4, 3)
    log = spark.createDataFrame(rows, "activity_id long, user_id long, ts timestamp_ntz, activity_type string, difficulty string, score double")
    want, totals, streaks = replay(rows)
    ledger = activity.xp_ledger(log).collect()
    assert {r["activity_id"]: (r["streak"], r["streak_before"], r["xp_gained"], r["total_xp"]) for r in ledger} == want
    assert all(r["level_up"] == (r["new_level"] > r["old_level"]) for r in ledger)
    final = activity.learner_levels(log).collect()
    assert {r["user_id"]: (r["xp"], r["current_streak"]) for r in final} == {u: (totals[u], streaks[u]) for u in totals}


def test_running_sums_equal_a_plain_window(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(9)}", rng.randrange(6), rng.randrange(100)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, k string, slice int, v int")
    got = ordered.running_sums(df, ["k"], [("slice", True)], [F.col("v"), F.col("id")], {"run": F.col("v"), "place": F.lit(1)})
    plain = Window.partitionBy("k").orderBy(F.col("slice").desc(), "v", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("run", F.sum("v").over(plain)).withColumn("place", F.row_number().over(plain))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_first_n_is_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    top = ordered.first_n(df, ["k"], [F.col("id").desc()], 2)
    plan = top._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert sorted((r["k"], r["id"], r["position"]) for r in top.collect()) == [
        (0, 96, 2), (0, 99, 1), (1, 94, 2), (1, 97, 1), (2, 95, 2), (2, 98, 1),
    ]


def test_topic_stats_take_the_last_score(spark):
    rows = [(1, 1, "t", "chat", 40.0), (2, 1, "t", "quiz", 90.0), (3, 1, "t", "quiz", 0.0), (4, 1, "t", "quiz", None)]
    df = spark.createDataFrame(rows, "id long, user_id long, topic string, activity_type string, score double")
    row = sessions.topic_stats(df.withColumn("duration_seconds", F.lit(5))).first()
    assert (row["sessions"], row["time"], row["last_score"]) == (4, 20, 90.0)
    stats = sessions.user_stats(df.withColumn("duration_seconds", F.lit(None).cast("int"))).first()
    assert (stats["total_time_seconds"], stats["total_sessions"], stats["average_score"]) == (0, 4, 45.0)


def mistakes(spark, counts):
    rows, n = [], 0
    for topic, (opened, closed) in counts.items():
        for i in range(opened + closed):
            rows.append((n, 1, topic, f"q{n}", "a", "b", day(1 + n), i >= opened))
            n += 1
    return spark.createDataFrame(
        rows, "id long, user_id long, topic string, question string, user_answer string, correct_answer string, timestamp timestamp_ntz, reviewed boolean"
    )


def test_recommendations(spark):
    log = mistakes(spark, {"b": (2, 5), "a": (3, 0), "c": (2, 0), "d": (1, 0), "e": (1, 0), "f": (1, 0), "g": (0, 4)})
    got = [(r["topic"], r["mistake_count"], r["priority"]) for r in sessions.recommendations(log).orderBy("position").collect()]
    assert got == [("a", 3, "high"), ("b", 2, "medium"), ("c", 2, "medium"), ("d", 1, "medium"), ("e", 1, "medium")]
    lists = {r["topic"]: [m["question"] for m in r["recent_mistakes"]] for r in sessions.recommendations(log).collect()}
    assert lists["a"] == ["q9", "q8", "q7"]
    pairs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "user_id long, topic string")
    left = sessions.mark_reviewed(log, pairs)
    assert left.count() == log.count()
    assert {r["topic"] for r in left.where("not reviewed").collect()} == {"b", "c", "d", "e", "f"}


def test_pair_sessions(spark):
    starts = spark.createDataFrame([(1, 7, day(1)), (2, 7, day(1))], "session_id long, user_id long, start_time timestamp_ntz")
    ends = spark.createDataFrame(
        [(1, 7, day(1, 8, 1, 1), 50.0), (9, 7, day(1), 1.0), (2, 8, day(2), 1.0)],
        "session_id long, user_id long, end_time timestamp_ntz, score double",
    )
    got = sorted((r["session_id"], r["duration_seconds"], r["score"]) for r in sessions.pair_sessions(starts, ends).collect())
    assert got == [(1, 61, 50.0), (2, 0, None)]


def catalogue(spark, n):
    return spark.range(n).select(
        "id", F.concat(F.lit("Ex "), "id").alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("created_at")
    )


def test_pages(spark):
    ex = catalogue(spark, 29)
    want = [r["id"] for r in ex.orderBy(F.col("created_at").desc(), "id").collect()]

    def page(number):
        return [r["id"] for r in exercises.page(ex, number).orderBy("position").collect()]

    assert page("1") == page(None) == page("x") == page("2.0") == want[:12]
    assert page("2") == want[12:24]
    assert page("3") == page("99") == page("0") == page("-1") == want[24:]
    assert exercises.page(ex.where("id < 0"), "1").count() == 0


def test_best_submission(spark):
    rows = [
        (1, "failed", 0.1, 1), (2, "success", 0.5, 2), (3, "success", 0.5, 3), (4, "success", 0.4, 4), (5, "success", 0.4, 5), (6, "pending", 0.0, 6),
    ]
    df = spark.createDataFrame([(i, 1, 1, s, t, day(d)) for i, s, t, d in rows], "id long, exercise_id long, user_id long, status string, execution_time double, submitted_at timestamp_ntz")
    row = exercises.progress(df).first()
    assert (row["attempts_count"], row["is_completed"], row["completed_at"], row["best_submission"]) == (5, True, day(2), 4)
    count = exercises.exercise_counters(df).first()
    assert (count["attempts_count"], count["success_count"]) == (5, 4)


def test_success_rate(spark):
    df = spark.createDataFrame([(0, 0), (3, 1), (4, 4)], "a long, s long")
    assert [r[0] for r in df.select(exercises.success_rate(F.col("a"), F.col("s"))).collect()] == [0.0, 33.3, 100.0]


def test_histogram(spark):
    rows = [(1, 1, s) for s in (0, 1, 1, -1)] + [(1, 2, s) for s in (0, 4)]
    df = spark.createDataFrame(rows, "room_id long, question_number int, selected_answer int")
    got = {r["question_number"]: (r["stats"], r["options"], r["timeouts"]) for r in rooms.answer_histogram(df).collect()}
    assert got == {1: ([1, 2, 0, 1], [1, 2, 0, 0], 1), 2: (None, [1, 0, 0, 0], 0)}


def test_final_results(spark):
    joined = [(1, u, day(1, u), True) for u in range(1, 7)] + [(1, 9, day(1), False)]
    players = spark.createDataFrame(joined, "room_id long, user_id long, joined_at timestamp_ntz, is_active boolean")
    scores = spark.createDataFrame([(1, 2, 500, 1), (1, 3, 500, 1), (1, 9, 900, 3)], "room_id long, user_id long, score long, correct_answers long")
    room = spark.createDataFrame([(1, 3)], "id long, num_questions int")
    got = [(r["user_id"], r["rank"], r["bonus_xp"], r["accuracy"]) for r in rooms.final_results(room, players, scores).orderBy("rank").collect()]
    assert got == [(2, 1, 50, 33.3), (3, 2, 40, 33.3), (1, 3, 30, 0.0), (4, 4, 20, 0.0), (5, 5, 10, 0.0), (6, 6, 10, 0.0)]


def test_all_answered_counts_players_who_left(spark):
    room = spark.createDataFrame([(1, 1, 5), (2, 1, 5)], "id long, current_question int, num_questions int")
    answers = spark.createDataFrame([(1, 8, 1), (1, 9, 1), (1, 8, 2)], "room_id long, user_id long, question_number int")
    players = spark.createDataFrame([(1, 8, True), (1, 7, True), (1, 9, False)], "room_id long, user_id long, is_active boolean")
    got = {r["room_id"]: (r["answered"], r["players"], r["all_answered"]) for r in rooms.all_answered(room, answers, players).collect()}
    assert got == {1: (2, 2, True), 2: (0, 0, True)}


def test_identity(spark):
    users = spark.createDataFrame([(1, "Ann", "ann@x"), (2, "bob", "ANN@x"), (3, "c@x", "c@x")], "id long, username string, email string")
    logins = spark.createDataFrame([("ANN",), ("ann@X",), ("C@X",), ("zoe",)], "login string")
    got = {r["login"]: (r["matches"], r["user_id"]) for r in rooms.resolve_users(logins, users).collect()}
    assert got == {"ANN": (1, 1), "ann@X": (2, None), "C@X": (1, 3)}


def test_grade_quiz(spark):
    q = [("q0", ["x", "y"], 0), ("q1", ["x", "y"], 1), ("q2", ["x", "y"], 0), ("q3", ["x", "y"], 1)]
    rows = [(1, 5, [0, 0], q), (2, 5, [0, 1, 0, 1, 1], q), (3, 5, [], []), (4, 5, [None], q), (5, 5, [-1, 5], q), (6, 5, [-3], q)]
    df = spark.createDataFrame(
        rows, "session_id long, user_id long, answers array<int>, questions array<struct<question:string,options:array<string>,correct_answer:int>>"
    )
    graded = quiztext.grade_quiz(df)
    assert {r["session_id"]: (r["ok"], r["score"]) for r in graded.collect()} == {
        1: (True, 25.0), 2: (False, None), 3: (False, None), 4: (False, None), 5: (True, 0.0), 6: (False, None),
    }
    wrong = quiztext.quiz_mistakes(graded).orderBy("session_id", "place").collect()
    assert [(r["topic"], r["question"], r["user_answer"], r["correct_answer"]) for r in wrong] == [
        ("1", "q1", "x", "y"), ("5", "q0", "y", "x"), ("5", "q1", "No answer", "y"),
    ]


QUIZZES = [
    ("A", "Q1. One?\nA. x\nB. y\nAnswer: \nQ2. Two\n  code\n\nA. x\nAnswer: BC\nRéponse: a\nexplication: because: so", [("One?", ["x"], 0, ""), ("Two\n  code", ["x"], 0, "because: so")]),
    ("B", "Q1. One?\nA. x\nAnswer: E\nQ2. Two?\nA. z\nAnswer: BC", [("Two?", ["z"], 1, "")]),
    ("C", "Q1. One?\nA. x\nAnswer: A\nQ2. Two?\nA. z", []),
    ("D", "no questions here", []),
    ("E", "Q1. One?\nAnswer: A\nno options", []),
    ("F", "Q1. One?\nA. x\njunk\nB.no\n  C. y  \nANSWER: c\nExplanation: first\nExplanation: last", [("One?", ["x", "y"], 2, "last")]),
    ("G", "Q1. \nA. x\nAnswer: A", []),
]


def test_parse_quiz(spark):
    rows = [(k, t.replace("One?\nA. x\nB. y\nAnswer: \n", "One?\nA. x\nAnswer: \n"), "fr", "loops") for k, t, _ in QUIZZES]
    parsed = quiztext.parse_quiz(spark.createDataFrame(rows, "quiz_id string, text string, language string, topic string"))
    got = {r["quiz_id"]: [(q["question"], q["options"], q["correct_answer"], q["explanation"]) for q in r["questions"]] for r in parsed.collect()}
    assert got == {k: want for k, _, want in QUIZZES}
    assert {r["quiz_id"] for r in parsed.where("failed").collect()} == {"C"}
    spare = {r["quiz_id"]: r for r in quiztext.with_fallback(parsed).where("is_fallback").collect()}
    assert set(spare) == {"C", "D", "E", "G"}
    assert spare["C"]["questions"][0]["question"] == "Question d'exemple sur loops"


GENERATED = [
    (1, 1, 'Hi\n```json\n{"title": "T", "description": "a\nb", "starter_code": "x\\\\ny", "solution": "s", "tests": [{"input": "f()", "expected": 3}]}\n```'),
    (2, 1, 'Sure {"title": "T", "description": "d", "starter_code": "c", "solution": "s", "tests": []} ok'),
    (3, 2, '{"title": "T", "description": "d", "solution": "s", "tests": [{"input": "g()", "expected": "1"}]}'),
    (4, 3, "nothing to read"),
    (5, 2, "{ broken"),
    (6, 2, '{"title": "say \\"hi\\" now", "starter_code": ```python\npass\n```, "tests": [oops]}'),
    (7, 3, "}"),
]


def test_repair(spark):
    df = spark.createDataFrame([(i, t, "loops") for i, _, t in GENERATED], "id int, text string, topic string")
    got = {r["id"]: r for r in generated.repair(df).collect()}
    assert {i: r["stage"] for i, r in got.items()} == {i: s for i, s, _ in GENERATED}
    assert (got[1]["description"], got[1]["starter_code"]) == ("a\nb", "x\ny")
    assert [(t["input"], t["expected"]) for t in got[1]["tests"]] == [("f()", "3")]
    assert got[2]["tests"] == []
    assert got[3]["starter_code"].startswith("# TODO: Implement your solution for loops\n\ndef")
    assert got[5]["title"] == "Exercise on loops" and got[5]["description"] == "Practical exercise on loops"
    assert got[6]["title"] == "say \\" and got[6]["starter_code"] == "pass\n"
    assert [(t["input"], t["expected"]) for t in got[6]["tests"]] == [("my_function()", "Hello World")]
    assert got[4]["description"] == "Practical exercise on loops. Complete the code below."


def test_repair_from_course(spark):
    good = '{"title": "T", "description": "a\nb", "starter_code": "c", "solution": "s", "tests": []}'
    two = good.replace("a\nb", "a\nb\nc")
    df = spark.createDataFrame([(1, good, "loops"), (2, two, "loops"), (3, "none", "loops")], "id int, text string, topic string")
    got = {r["id"]: r for r in generated.repair(df, from_course=True).collect()}
    assert (got[1]["stage"], got[1]["description"]) == (1, "a\nb")
    assert (got[2]["stage"], got[2]["title"]) == (2, "T")
    assert got[3]["title"] == "Practical exercise: loops"


def test_markdown(spark):
    text = "# A\n```python\n# no\n```\n###### six\n## B ##\n- one\n+ two\n-no\n| a || b |\n|---|:-:|\n| 1 | 2 |\n|  | x |\nend\n```\nraw\n```"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert [(r["level"], r["title"]) for r in markdown.headings(df).orderBy("position").collect()] == [(1, "A"), (2, "B ##")]
    assert [(r["language"], r["code"]) for r in markdown.code_blocks(df).orderBy("position").collect()] == [("python", "# no"), ("code", "raw")]
    assert [(r["language"], r["code"]) for r in markdown.code_blocks(df, chat=True).orderBy("position").collect()] == [("python", "# no\n"), ("txt", "raw\n")]
    assert [r["item"] for r in markdown.list_items(df).orderBy("position").collect()] == ["one", "two"]
    table = markdown.md_tables(df).first()
    assert (table["header"], table["rows"]) == (["a", "b"], [["1", "2"], ["", "x"]])


def test_long_tables_and_pipe_lines_end(spark):
    long = "| a |\n|---|\n" + "| x |\n" * 20000 + "end " + "|" * 3000
    table = markdown.md_tables(spark.createDataFrame([(1, long)], "id int, text string")).first()
    assert len(table["rows"]) == 20000


def test_policy(spark):
    rows = [(1, "import os, time"), (2, "import os"), (3, "x = profile"), (4, " from os import path\nexec"), (5, "y = 1"), (6, "important\nimport  re")]
    got = {r["id"]: (r["forbidden_imports"], r["forbidden_words"], r["verdict"]) for r in codecheck.policy_scan(spark.createDataFrame(rows, "id int, code string")).collect()}
    assert got == {
        1: ([], [], "clean"), 2: (["os"], [], "import"), 3: ([], ["file"], "word"), 4: (["os"], ["exec"], "import"), 5: ([], [], "clean"), 6: ([], [], "clean"),
    }


def test_grade_runs(spark):
    rows = [
        (1, True, "None\n5\n", "", None, "5"),
        (2, False, "", "boom", "ValueError", "Exception"),
        (3, False, "", "boom", "KeyError", "ValueError"),
        (4, False, "", "boom", "KeyError", "7"),
        (5, True, "None", "", None, "None"),
        (6, True, "4", "", None, "5"),
        (7, False, "", "refused", None, "TypeError"),
    ]
    df = spark.createDataFrame(rows, "id int, success boolean, output string, error string, exception_type string, expected string")
    got = {r["id"]: (r["passed"], r["actual"], r["error"]) for r in codecheck.grade_runs(df).collect()}
    assert got == {
        1: (True, "5", ""), 2: (True, "Exception", ""), 3: (False, "", "Expected error (ValueError) but got: KeyError"), 4: (False, "", "boom"),
        5: (True, "None", ""), 6: (False, "4", "Attendu: 5, Obtenu: 4"), 7: (False, "", "Expected error (TypeError) but got: unknown error"),
    }


INDEX = "module string, section string, section_pos int, file string, file_pos int"


def test_classify(spark):
    index = spark.createDataFrame(
        [("01_sql", "joins", 1, "a.md", 0), ("01_sql", "early", 0, "a.md", 0), ("ressources", "sheets", 0, "s.md", 0), ("plain", "empty", 0, None, None)], INDEX
    )
    rows = [
        ("/c/01_sql/a.md", "a.md", "01_sql"), ("/c/01_sql/b.md", "b.md", "01_sql"), ("/r/resources/sql__x.md", "sql__x.md", "resources"),
        ("/r/resources/s.md", "s.md", "resources"), ("/r/resources/t.md", "t.md", "resources"), ("/c/01_sql/deep/a.md", "a.md", "deep"), ("/c/plain/a.md", "a.md", "plain"),
    ]
    files = corpus.classify(spark.createDataFrame(rows, "path string, name string, parent string"), index)
    assert {r["path"]: r["section"] for r in files.collect()} == {
        "/c/01_sql/a.md": "early", "/c/01_sql/b.md": "unknown", "/r/resources/sql__x.md": "sql", "/r/resources/s.md": "sheets",
        "/r/resources/t.md": "ressources", "/c/01_sql/deep/a.md": "unknown", "/c/plain/a.md": "unknown",
    }
    kept = corpus.covered(files.where("parent = 'resources'"), corpus.modules(index))
    assert [r["section"] for r in kept.collect()] == ["sql"]


def test_search(spark):
    index = spark.createDataFrame(
        [("m", "01_loops", 0, "Loops.md", 0), ("m", "01_loops", 0, "x.md", 1), ("m", "more_loops", 1, None, None), ("n", "01_loops", 0, "y", 0)], INDEX
    )
    queries = spark.createDataFrame([(1, "m", "01_LOOPS"), (2, "m", "loops"), (3, "m", ""), (4, "m", "s."), (5, "z", "x")], "query_id long, module string, query string")
    rows = corpus.by_relevance(corpus.search_index(index, queries)).orderBy("query_id", "position").collect()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["type"], r["section"], r["file"], r["relevance"]))
    assert got == {
        1: [("section", "01_loops", None, "high")],
        2: [("file", "01_loops", "Loops.md", "high"), ("section", "01_loops", None, "medium"), ("section", "more_loops", None, "medium")],
        3: [("file", "01_loops", "Loops.md", "high"), ("file", "01_loops", "x.md", "high"), ("section", "01_loops", None, "medium"), ("section", "more_loops", None, "medium")],
        4: [("file", "01_loops", "Loops.md", "high")],
    }


def test_modules(spark):
    index = spark.createDataFrame([("a_b", f"s{i}_x", i, f"f{j}", j) for i in range(5) for j in range(2)] + [("empty", "only", 0, None, None)], INDEX)
    got = {r["id"]: (r["name"], r["description"], r["sections_count"], r["files_count"]) for r in corpus.with_general(corpus.module_stats(index)).collect()}
    assert got == {
        "general": ("General", "General questions on all topics", 0, 0),
        "a_b": ("A B", "S0 X, S1 X, S2 X and 2 other sections", 5, 10),
        "empty": ("Empty", "Only", 1, 0),
    }
    courses = spark.createDataFrame([(1, "a_b"), (2, "general"), (3, "other_one"), (4, "")], "id int, module string")
    named = {r["id"]: r["module_name"] for r in corpus.with_module_name(courses, corpus.module_stats(index)).collect()}
    assert named == {1: "A B", 2: None, 3: "Other One", 4: None}
    fresh = {r["id"]: r["module_name"] for r in corpus.with_module_name(courses, corpus.module_stats(index), saved=False).collect()}
    assert fresh == {1: "A B", 2: "general", 3: "other_one", 4: ""}


def test_sinks(spark):
    existing = spark.createDataFrame([(1, 1, "old", False), (1, 2, "old", True)], "room_id int, user_id int, tag string, is_active boolean")
    new = spark.createDataFrame([(1, 1, "x", True), (1, 3, "z", True), (1, 3, "y", True)], "room_id int, user_id int, tag string, is_active boolean")
    merged = sinks.insert_if_absent(existing, new, ["room_id", "user_id"], "is_active")
    assert sorted(map(tuple, merged.collect())) == [(1, 1, "old", True), (1, 2, "old", True), (1, 3, "y", True)]
    parent = spark.createDataFrame([(1, 10), (2, 20)], "id int, owner_id int")
    asks = spark.createDataFrame([(1, 10), (2, 10), (1, 10)], "id int, user_id int")
    kids = spark.createDataFrame([(5, 1), (6, 2)], "kid int, parent_id int")
    left = sinks.delete_owned(parent, asks, {"kids": (kids, "parent_id")})
    assert [r["id"] for r in left["parent"].collect()] == [2] and [r["kid"] for r in left["kids"].collect()] == [6]
    progress = spark.createDataFrame([(1, 7), (2, 8)], "user_id int, best_submission int")
    gone = spark.createDataFrame([(7,)], "id int")
    assert sorted(map(tuple, sinks.forget_best(progress, gone).collect())) == [(1, None), (2, 8)]


def test_date_buckets_are_half_open(spark):
    days = ["2023-12-31 23:59:59", "2024-01-01 00:00:00", "2024-02-26 23:59:59", "2024-02-27 00:00:00", "2024-03-05 00:00:00", "2024-03-05 23:59:59",
            "2024-03-06 00:00:00", "2024-03-31 23:59:59", "2024-04-01 00:00:00", "2024-12-31 23:59:59", "2025-01-01 00:00:00"]
    df = spark.createDataFrame(list(enumerate(days)), "id int, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {
        name: [r.id for r in exercises.admin_search(df, "", [], bucket=("at", name, "2024-03-05")).orderBy("id").collect()]
        for name in ("today", "7 days", "month", "year")
    }
    assert got == {"today": [4, 5], "7 days": [3, 4, 5], "month": [4, 5, 6, 7], "year": list(range(1, 10))}
