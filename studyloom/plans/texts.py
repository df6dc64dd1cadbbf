"""Course, quiz and exercise texts, payloads, and code checks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as txt
from ..operators import codecheck, generated, markdown, quiztext
from ..schemas import ANSWER_MESSAGE, CHAT_PAYLOAD, QUIZ_SUBMISSION_PAYLOAD, SUBMISSION_PAYLOAD
from ..session import shared_folder
from ..sources import entities, payloads, sinks
from .registry import query, table, view


# Courses -------------------------------------------------------------------


@query(
    "project_course_title",
    "SELECT id, coalesce(nullif(regexp_extract(content, '(?m)^# (.+)$', 1), ''), title) AS title FROM <fx_courses> c",
)
def project_course_title(spark, folder):
    return view(spark, folder, "fx_courses").select(
        "id", txt.course_title(F.col("content"), F.col("title")).alias("title")
    )


@query(
    "project_truncated_title",
    "SELECT id, CASE WHEN length(title) > 30 THEN concat(substring(title, 1, 30), '...') ELSE title END AS title FROM <fx_courses> c",
)
def project_truncated_title(spark, folder):
    return view(spark, folder, "fx_courses").select("id", txt.truncate(F.col("title")).alias("title"))


@query(
    "filter_owned_courses",
    "SELECT id, title, CAST(created_at AS VARCHAR) AS created_at FROM <fx_courses> c WHERE created_by = 7",
)
def filter_owned_courses(spark, folder):
    owned = view(spark, folder, "fx_courses").where("created_by = 7")
    newest = owned.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return newest.select("id", "title", F.col("created_at").cast("string").alias("created_at"))


# Markdown ------------------------------------------------------------------


@query(
    "extract_code_blocks",
    r"""WITH b AS (SELECT id, regexp_extract_all(text, '```(\w+)?\n?([\s\S]*?)```', 1) AS l, regexp_extract_all(text, '```(\w+)?\n?([\s\S]*?)```', 2) AS c FROM <fx_markdown> m)
    SELECT id, i - 1 AS position, CASE WHEN coalesce(l[i], '') = '' THEN 'code' ELSE l[i] END AS language, trim(c[i], concat(' ', chr(10))) AS code
    FROM b, unnest(range(1, len(l) + 1)) u(i)""",
)
def extract_code_blocks(spark, folder):
    return markdown.code_blocks(view(spark, folder, "fx_markdown"))


@query(
    "extract_code_blocks_chat",
    r"""WITH b AS (SELECT id, regexp_extract_all(text, '```(\w+)?\n([\s\S]*?)```', 1) AS l, regexp_extract_all(text, '```(\w+)?\n([\s\S]*?)```', 2) AS c FROM <fx_markdown> m)
    SELECT id, i - 1 AS position, CASE WHEN coalesce(l[i], '') = '' THEN 'txt' ELSE l[i] END AS language, c[i] AS code
    FROM b, unnest(range(1, len(l) + 1)) u(i)""",
)
def extract_code_blocks_chat(spark, folder):
    return markdown.code_blocks(view(spark, folder, "fx_markdown"), chat=True)


_BARE = r"SELECT id, regexp_replace(text, '```(\w+)?\n?([\s\S]*?)```', '<code>', 'g') AS text FROM <fx_markdown> m"
_CHAT_BARE = r"SELECT id, regexp_replace(text, '```(\w+)?\n([\s\S]*?)```', '<code>', 'g') AS text FROM <fx_markdown> m"


@query(
    "extract_headings",
    rf"""WITH b AS (SELECT id, regexp_extract_all(text, '(?m)^(#{{1,5}}) (.*)$', 1) AS l, regexp_extract_all(text, '(?m)^(#{{1,5}}) (.*)$', 2) AS t FROM ({_BARE}) m)
    SELECT id, i - 1 AS position, length(l[i]) AS level, t[i] AS title FROM b, unnest(range(1, len(l) + 1)) u(i)""",
)
def extract_headings(spark, folder):
    return markdown.headings(view(spark, folder, "fx_markdown"))


@query(
    "extract_list_items",
    rf"""WITH b AS (SELECT id, regexp_extract_all(text, '(?m)^[\-\*\+•] (.+)$', 1) AS l FROM ({_BARE}) m)
    SELECT id, 'bullet' AS kind, i - 1 AS position, l[i] AS item FROM b, unnest(range(1, len(l) + 1)) u(i)""",
)
def extract_list_items(spark, folder):
    return markdown.list_items(view(spark, folder, "fx_markdown"))


@query(
    "extract_list_items_chat",
    rf"""WITH b AS (SELECT id, regexp_extract_all(text, '(?:^|\n)[\*-]\s+(.+)', 1) AS l, regexp_extract_all(text, '(?:^|\n)\d+\.\s+(.+)', 1) AS n FROM ({_CHAT_BARE}) m)
    SELECT id, 'bullet' AS kind, i - 1 AS position, l[i] AS item FROM b, unnest(range(1, len(l) + 1)) u(i)
    UNION ALL SELECT id, 'numbered', i - 1, n[i] FROM b, unnest(range(1, len(n) + 1)) u(i)""",
)
def extract_list_items_chat(spark, folder):
    return markdown.list_items(view(spark, folder, "fx_markdown"), chat=True)


_TABLE = r"(\|[^\n]+)\n\|(?:\s*[-:]+\s*\|)+\n((?:\|[^\n]+\n)+)"
_CELLS = "list_transform(list_filter(string_split({x}, '|'), lambda c: c <> ''), lambda c: trim(c))"


@query(
    "extract_md_tables",
    rf"""WITH b AS (SELECT id, regexp_extract_all(text, '{_TABLE}', 1) AS h, regexp_extract_all(text, '{_TABLE}', 2) AS r FROM ({_CHAT_BARE}) m),
    t AS (SELECT id, i - 1 AS position, h[i] AS header, string_split(trim(r[i], chr(10)), chr(10)) AS rows FROM b, unnest(range(1, len(h) + 1)) u(i))
    SELECT id, position, array_to_string({_CELLS.format(x='header')}, ';') AS header, j - 1 AS row_number, array_to_string({_CELLS.format(x='rows[j]')}, ';') AS cells
    FROM t, unnest(range(1, len(rows) + 1)) v(j)""",
)
def extract_md_tables(spark, folder):
    tables = markdown.md_tables(view(spark, folder, "fx_markdown"))
    return tables.select(
        "id", "position", F.array_join("header", ";").alias("header"), F.posexplode("rows").alias("row_number", "row")
    ).select("id", "position", "header", "row_number", F.array_join("row", ";").alias("cells"))


# Quizzes -------------------------------------------------------------------

_BLANKS = "concat(' ', chr(9), chr(10), chr(13))"
_QUIZ = rf"""WITH blocks AS (SELECT quiz_id, language, topic, string_split_regex(concat(chr(10), trim(text, {_BLANKS})), '\nQ[0-9]+\.') AS parts FROM <fx_quiz_text> q),
each AS (SELECT quiz_id, n, string_split(trim(parts[n], {_BLANKS}), chr(10)) AS lines FROM blocks, unnest(range(2, len(parts) + 1)) u(n)),
marked AS (SELECT *, list_transform(lines, lambda l: trim(l, {_BLANKS})) AS bare FROM each),
cut AS (SELECT *, coalesce(list_position(list_transform(bare, lambda l: regexp_matches(l, '^[A-D]\. ')), true), 0) AS first FROM marked),
fields AS (SELECT quiz_id, n,
    trim(array_to_string(CASE WHEN first = 0 THEN lines ELSE lines[1:first - 1] END, chr(10)), {_BLANKS}) AS question,
    list_transform(list_filter(bare, lambda l: regexp_matches(l, '^[A-D]\. ')), lambda l: trim(l[4:], {_BLANKS})) AS options,
    CASE WHEN first > 0 THEN list_filter(bare[first:], lambda l: regexp_matches(lower(l), '^(answer|réponse):'))[-1] END AS answer_line,
    CASE WHEN first > 0 THEN list_filter(bare[first:], lambda l: regexp_matches(lower(l), '^(explanation|explication):'))[-1] END AS explanation_line FROM cut),
judged AS (SELECT *, upper(trim(regexp_replace(answer_line, '^[^:]*:', ''), {_BLANKS})) AS letter, coalesce(trim(regexp_replace(explanation_line, '^[^:]*:', ''), {_BLANKS}), '') AS explanation FROM fields),
failed AS (SELECT DISTINCT quiz_id FROM judged WHERE question <> '' AND len(options) > 0 AND letter IS NULL),
kept AS (SELECT *, row_number() OVER (PARTITION BY quiz_id ORDER BY n) AS question_number, instr('ABCD', letter) - 1 AS correct_answer FROM judged
  WHERE question <> '' AND len(options) > 0 AND contains('ABCD', letter) AND quiz_id NOT IN (SELECT quiz_id FROM failed))"""


@query(
    "parse_quiz_text",
    f"{_QUIZ} SELECT quiz_id, question_number, question, array_to_string(options, '|') AS options, correct_answer, explanation FROM kept",
)
def parse_quiz_text(spark, folder):
    parsed = quiztext.parse_quiz(view(spark, folder, "fx_quiz_text"))
    return quiztext.question_rows(parsed).select(
        "quiz_id",
        "question_number",
        "question",
        F.array_join("options", "|").alias("options"),
        "correct_answer",
        "explanation",
    )


@query(
    "quiz_fallback",
    f"""{_QUIZ} SELECT quiz_id, question_number, question, array_to_string(options, '|') AS options, correct_answer, explanation, false AS is_fallback FROM kept
    UNION ALL SELECT quiz_id, 1, concat(CASE WHEN language = 'fr' THEN 'Question d''exemple sur ' ELSE 'Example question on ' END, topic), 'Option A|Option B|Option C|Option D', 0,
      CASE WHEN language = 'fr' THEN 'Explication d''exemple' ELSE 'Sample explanation' END, true FROM <fx_quiz_text> q WHERE quiz_id NOT IN (SELECT quiz_id FROM kept)""",
)
def quiz_fallback(spark, folder):
    parsed = quiztext.with_fallback(quiztext.parse_quiz(view(spark, folder, "fx_quiz_text")))
    return quiztext.question_rows(parsed).select(
        "quiz_id",
        "question_number",
        "question",
        F.array_join("options", "|").alias("options"),
        "correct_answer",
        "explanation",
        "is_fallback",
    )


@query("fn_letter_index", f"{_QUIZ} SELECT quiz_id, n, letter, instr('ABCD', letter) - 1 AS position FROM judged WHERE letter IS NOT NULL")
def fn_letter_index(spark, folder):
    """Answer letters of all blocks that have one, before any block is dropped."""
    blocks = view(spark, folder, "fx_quiz_text").select(
        "quiz_id", F.posexplode(F.split("text", quiztext.QUESTION_MARK)).alias("n", "block")
    )
    letter = F.upper(txt.strip(F.regexp_extract("block", r"(?mi)^\s*(?:answer|réponse):(.*)$", 1)))
    return (
        blocks.where(F.col("block").rlike(r"(?mi)^\s*(?:answer|réponse):"))
        .select("quiz_id", (F.col("n") + 1).alias("n"), letter.alias("letter"))
        .withColumn("position", txt.letter_index(F.col("letter")))
    )


def _solo_quizzes(spark, folder):
    """One submission per order: up to four answers to a three-question quiz."""
    question = F.transform(
        F.sequence(F.lit(0), F.lit(2)),
        lambda i: F.struct(
            F.concat(F.lit("q"), i.cast("string")).alias("question"),
            F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("options"),
            ((F.col("o_custkey") + i) % 3).cast("int").alias("correct_answer"),
        ),
    )
    answers = F.transform(
        F.sequence(F.lit(0), (F.col("o_orderkey") % 5).cast("int")),
        lambda i: ((F.col("o_orderkey") + i * 2) % 7).cast("int") - 2,
    )
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("session_id"),
        F.col("o_custkey").alias("user_id"),
        answers.alias("answers"),
        question.alias("questions"),
    )


_GRADED = """WITH a AS (SELECT o_orderkey AS session_id, o_custkey AS user_id, i, CAST((o_orderkey + i * 2) % 7 - 2 AS INT) AS answer, (o_custkey + i) % 3 AS key, o_orderkey % 5 + 1 AS given
  FROM orders, unnest(range(0, o_orderkey % 5 + 1)) u(i)),
ok AS (SELECT session_id, user_id, given <= 3 AS ok, count(*) FILTER (WHERE answer = key) AS right_answers FROM a GROUP BY ALL)"""


@query(
    "agg_quiz_score",
    f"""{_GRADED} SELECT session_id, ok, CASE WHEN ok THEN right_answers END AS correct_answers, 3 AS total_questions, CASE WHEN ok THEN round(right_answers / 3 * 100, 6) END AS score FROM ok""",
)
def agg_quiz_score(spark, folder):
    graded = quiztext.grade_quiz(_solo_quizzes(spark, folder))
    return graded.select("session_id", "ok", "correct_answers", "total_questions", F.round("score", 6).alias("score"))


_GIVEN = "CASE WHEN answer >= 3 THEN 'No answer' WHEN answer < 0 THEN ['a', 'b', 'c'][4 + answer] ELSE ['a', 'b', 'c'][answer + 1] END"


@query(
    "quiz_mistakes",
    f"""{_GRADED} SELECT a.session_id, a.user_id, CAST(a.session_id AS VARCHAR) AS topic, 'quiz_wrong_answer' AS mistake_type, concat('q', i) AS question,
      {_GIVEN} AS user_answer, ['a', 'b', 'c'][key + 1] AS correct_answer, s.topic AS session_topic
    FROM a JOIN ok ON ok.session_id = a.session_id LEFT JOIN <fx_sessions> s ON s.id = a.session_id WHERE ok.ok AND answer <> key""",
)
def quiz_mistakes(spark, folder):
    graded = quiztext.grade_quiz(_solo_quizzes(spark, folder))
    return quiztext.quiz_mistakes(graded, view(spark, folder, "fx_sessions")).drop("place")


@query("fn_answer_text", f"{_GRADED} SELECT session_id, i, answer, {_GIVEN} AS answer_text FROM a")
def fn_answer_text(spark, folder):
    rows = _solo_quizzes(spark, folder).select("session_id", F.posexplode("answers").alias("i", "answer"))
    options = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return rows.withColumn("answer_text", txt.answer_text(options, F.col("answer")))


def _message_sql(language):
    bands = quiztext.FEEDBACK[language]
    quoted = ["'" + m.replace("'", "''") + "'" for m in bands]
    return (
        f"CASE WHEN p >= 90 THEN {quoted[0]} WHEN p >= 70 THEN {quoted[1]} WHEN p >= 50 THEN {quoted[2]} ELSE {quoted[3]} END"
    )


@query(
    "project_quiz_feedback",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) % 11 AS correct, 10 + l_linenumber % 3 AS total, CASE l_returnflag WHEN 'A' THEN 'fr' WHEN 'R' THEN 'en' END AS language FROM lineitem),
    s AS (SELECT *, CAST(floor(correct / total * 100 + 0.5) AS BIGINT) AS p FROM r)
    SELECT l_orderkey, l_linenumber, correct, total, p AS percentage, CASE WHEN language = 'fr' THEN {_message_sql('fr')} ELSE {_message_sql('en')} END AS message FROM s""",
)
def project_quiz_feedback(spark, folder):
    results = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "CAST(l_quantity AS INT) % 11 AS correct",
        "10 + l_linenumber % 3 AS total",
        "CASE l_returnflag WHEN 'A' THEN 'fr' WHEN 'R' THEN 'en' END AS language",
    )
    return quiztext.quiz_feedback(results).drop("language")


# Generated exercises -------------------------------------------------------

_EXERCISE_SQL = r"""WITH t AS (SELECT id, topic, text, id % 9 AS kind FROM <fx_exercise_text> x),
f AS (SELECT *, CASE WHEN kind IN (0, 1, 4, 5) THEN 1 WHEN kind IN (2, 6, 7) THEN 2 ELSE 3 END AS stage,
  regexp_extract(text, '"title":\s*"([^"]*)"', 1) AS raw_title, regexp_extract(text, '"description":\s*"([^"]*)"', 1) AS raw_description FROM t),
e AS (SELECT id, topic, kind, stage,
  CASE WHEN stage = 3 THEN concat('Exercise on ', topic) ELSE raw_title END AS title,
  CASE WHEN stage = 3 THEN concat('Practical exercise on ', topic, '. Complete the code below.') ELSE raw_description END AS description,
  CASE kind WHEN 0 THEN concat('def f():', chr(10), chr(9), 'pass') WHEN 1 THEN 'a' WHEN 4 THEN concat('def h():', chr(10), '  pass') WHEN 5 THEN 'u' WHEN 6 THEN 'u'
    ELSE concat('# TODO: Implement your solution for ', topic, chr(10), chr(10), 'def my_function():', chr(10), '    # Your code here', chr(10), '    pass', CASE WHEN stage = 3 THEN chr(10) ELSE '' END) END AS starter_code,
  CASE kind WHEN 0 THEN 'x' WHEN 1 THEN 'b' WHEN 2 THEN 'return 1' WHEN 4 THEN 's' WHEN 5 THEN 'v'
    ELSE concat('# Example solution for ', topic, chr(10), chr(10), 'def my_function():', chr(10), '    return ''Hello World''', CASE WHEN stage = 3 THEN chr(10) ELSE '' END) END AS solution
  FROM f)"""


def _exercises(spark, folder):
    return generated.repair(view(spark, folder, "fx_exercise_text"))


_EXERCISE_COLUMNS = ["id", "title", "description", "starter_code", "solution"]
_EXERCISE_LIST = ", ".join(_EXERCISE_COLUMNS)


@query("json_repair", f"{_EXERCISE_SQL} SELECT stage, {_EXERCISE_LIST} FROM e")
def json_repair(spark, folder):
    return _exercises(spark, folder).select("stage", *_EXERCISE_COLUMNS)


for _stage, _name in enumerate(["json_repair_stage1", "json_repair_stage2", "json_repair_fallback"], start=1):

    @query(_name, f"{_EXERCISE_SQL} SELECT {_EXERCISE_LIST} FROM e WHERE stage = {_stage}")
    def json_repair_one(spark, folder, stage=_stage):
        return _exercises(spark, folder).where(F.col("stage") == stage).select(*_EXERCISE_COLUMNS)


# The course form escapes only the last line break of a value, so a text with two of them (kind 0) goes to the second stage.
_COURSE_SQL = r"""WITH t AS (SELECT id, topic, text, id % 9 AS kind FROM <fx_exercise_text> x),
f AS (SELECT *, CASE WHEN kind IN (1, 4, 5) THEN 1 WHEN kind IN (0, 2, 6, 7) THEN 2 ELSE 3 END AS stage,
  regexp_extract(text, '"title":\s*"([^"]*)"', 1) AS raw_title, regexp_extract(text, '"description":\s*"([^"]*)"', 1) AS raw_description,
  concat('# Exercise based on course: ', topic, chr(10), '# TODO: Implement your solution', chr(10), chr(10), 'def my_function():', chr(10), '    # Your code here', chr(10), '    pass') AS stub,
  concat('# Example solution for ', topic, chr(10), chr(10), 'def my_function():', chr(10), '    return ''Hello World''') AS sample FROM t)
SELECT id, stage, CASE WHEN stage = 3 THEN concat('Practical exercise: ', topic) ELSE raw_title END AS title,
  CASE WHEN stage = 3 THEN concat('Practical exercise based on the course ''', topic, '''. Complete the code below to practice the learned concepts.') ELSE raw_description END AS description,
  CASE kind WHEN 0 THEN concat('def f():', chr(10), chr(9), 'pass') WHEN 1 THEN 'a' WHEN 4 THEN concat('def h():', chr(10), '  pass') WHEN 5 THEN 'u' WHEN 6 THEN 'u' ELSE concat(stub, CASE WHEN stage = 3 THEN chr(10) ELSE '' END) END AS starter_code,
  CASE kind WHEN 0 THEN 'x' WHEN 1 THEN 'b' WHEN 2 THEN 'return 1' WHEN 4 THEN 's' WHEN 5 THEN 'v' ELSE concat(sample, CASE WHEN stage = 3 THEN chr(10) ELSE '' END) END AS solution FROM f"""


@query("json_repair_course", _COURSE_SQL)
def json_repair_course(spark, folder):
    """Exercises asked for from a course: another rule for line breaks, other placeholders."""
    return generated.repair(view(spark, folder, "fx_exercise_text"), from_course=True).select("stage", *_EXERCISE_COLUMNS)


@query(
    "json_repair_tests",
    """SELECT id, CASE id % 9 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN NULL ELSE 1 END AS n_tests,
    CASE id % 9 WHEN 0 THEN 'f(1)' WHEN 1 THEN NULL WHEN 2 THEN 'g()' WHEN 4 THEN 'h()' WHEN 5 THEN NULL ELSE 'my_function()' END AS first_input FROM <fx_exercise_text> x""",
)
def json_repair_tests(spark, folder):
    first = F.get("tests", F.lit(0))["input"]
    n = F.when(F.col("tests").isNotNull(), F.size("tests"))
    return _exercises(spark, folder).select("id", n.alias("n_tests"), first.alias("first_input"))


# Code ----------------------------------------------------------------------


@query(
    "code_policy_scan",
    """WITH k AS (SELECT p_partkey AS id, p_size % 8 AS kind, p_name FROM part)
    SELECT id, CASE kind WHEN 1 THEN 'os' WHEN 2 THEN 'subprocess' WHEN 5 THEN 'glob,pickle' ELSE '' END AS forbidden_imports,
      concat_ws(',', CASE WHEN kind = 6 OR contains(p_name, 'eval') THEN 'eval' END, CASE WHEN kind = 3 THEN 'file' END) AS forbidden_words,
      CASE WHEN kind IN (1, 2, 5) THEN 'import' WHEN kind IN (3, 6) THEN 'word' ELSE 'clean' END AS verdict FROM k""",
)
def code_policy_scan(spark, folder):
    return codecheck.policy_scan(view(spark, folder, "fx_code")).select(
        "id",
        F.array_join("forbidden_imports", ",").alias("forbidden_imports"),
        F.array_join("forbidden_words", ",").alias("forbidden_words"),
        "verdict",
    )


@query(
    "code_policy_scan_tests",
    """WITH k AS (SELECT p_partkey AS id, p_size % 8 AS kind, p_name, p_partkey % 3 AS call FROM part)
    SELECT id, CASE kind WHEN 1 THEN 'os' WHEN 2 THEN 'subprocess' WHEN 5 THEN 'glob,pickle' ELSE '' END AS forbidden_imports,
      concat_ws(',', CASE WHEN kind = 6 OR contains(p_name, 'eval') OR call = 2 THEN 'eval' END, CASE WHEN kind = 3 THEN 'file' END, CASE WHEN call = 0 THEN 'open' END) AS forbidden_words,
      CASE WHEN kind IN (1, 2, 5) THEN 'import' WHEN kind IN (3, 6) OR call <> 1 THEN 'word' ELSE 'clean' END AS verdict FROM k""",
)
def code_policy_scan_tests(spark, folder):
    """The code with the call of its test behind it: two calls in three use a forbidden word."""
    call = F.expr("CASE id % 3 WHEN 0 THEN 'f(open(\"x\"))' WHEN 1 THEN 'f(1)' ELSE 'eval(\"2\")' END")
    code = view(spark, folder, "fx_code")
    return codecheck.policy_scan(code.withColumn("code", codecheck.with_test_call(F.col("code"), call))).select(
        "id",
        F.array_join("forbidden_imports", ",").alias("forbidden_imports"),
        F.array_join("forbidden_words", ",").alias("forbidden_words"),
        "verdict",
    )


@query(
    "grade_test_runs",
    """WITH r AS (SELECT *, trim(expected) AS e, id % 7 AS kind, (SELECT 1) AS one FROM <fx_runs> r),
    a AS (SELECT *, CASE kind WHEN 0 THEN '5' WHEN 1 THEN trim(output, concat(' ', chr(10))) WHEN 2 THEN 'None' ELSE '5' END AS printed,
      (e IN ('Exception', 'raises ValueError')) AS awaited FROM r),
    p AS (SELECT *, CASE WHEN success THEN printed = e ELSE (e = 'Exception' AND exception_type IN ('TypeError', 'ValueError')) OR (e = 'raises ValueError' AND exception_type = 'ValueError') END AS passed FROM a)
    SELECT id, expected, exception_type, passed, CASE WHEN success THEN printed WHEN passed THEN e ELSE '' END AS actual,
      CASE WHEN passed THEN '' WHEN success THEN concat('Attendu: ', e, ', Obtenu: ', printed) WHEN awaited THEN concat('Expected error (', e, ') but got: ', exception_type) ELSE error END AS error FROM p""",
)
def grade_test_runs(spark, folder):
    return codecheck.grade_runs(view(spark, folder, "fx_runs"))


# Payloads and tables -------------------------------------------------------

_BODY = """CASE event_id % 6 WHEN 0 THEN '{"code": "  "}' WHEN 1 THEN concat('{"code": "x', event_id, '"}') WHEN 2 THEN '{"code": ' WHEN 3 THEN '{"other": 1}'
  WHEN 4 THEN concat('{"code": "y"} ', event_type) ELSE concat('{"message": "hi", "code": "', event_type, '"}') END"""


@query(
    "scan_json_payloads",
    """SELECT event_id, CASE event_id % 6 WHEN 1 THEN concat('x', event_id) WHEN 5 THEN event_type END AS code,
    CASE event_id % 6 WHEN 0 THEN 'Empty code' WHEN 3 THEN 'Empty code' WHEN 2 THEN 'Invalid JSON format' WHEN 4 THEN 'Invalid JSON format' END AS reason FROM events""",
)
def scan_json_payloads(spark, folder):
    bodies = table(spark, folder, "events").select("event_id", F.expr(_BODY).alias("body"))
    judged = payloads.judge_payloads(bodies, SUBMISSION_PAYLOAD, "code")
    return judged.select("event_id", F.when(F.col("reason").isNull(), F.col("payload.code")).alias("code"), "reason")


@query(
    "scan_json_payloads_answer",
    """SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN event_id % 4 END AS answer,
    CASE event_id % 5 WHEN 0 THEN 60.0 WHEN 1 THEN value WHEN 2 THEN 60.0 WHEN 3 THEN 12.5 END AS response_time,
    CASE WHEN event_id % 5 = 4 THEN 'Invalid JSON format' END AS reason FROM events""",
)
def scan_json_payloads_answer(spark, folder):
    """Answer messages; two in five come without a time."""
    body = """CASE event_id % 5 WHEN 0 THEN concat('{"type": "submit_answer", "answer": ', event_id % 4, '}') WHEN 1 THEN concat('{"answer": ', event_id % 4, ', "response_time": ', value, '}')
      WHEN 2 THEN concat('{"response_time": null, "answer": ', event_id % 4, '}') WHEN 3 THEN concat('{"answer": ', event_id % 4, ', "response_time": 12.5, "more": [1]}') ELSE '{"answer": ' END"""
    bodies = table(spark, folder, "events").select("event_id", F.expr(body).alias("body"))
    judged = payloads.judge_payloads(bodies, ANSWER_MESSAGE)
    time = F.when(F.col("reason").isNull(), payloads.answer_time())
    return judged.select("event_id", F.col("payload.answer").cast("long").alias("answer"), time.alias("response_time"), "reason")


@query(
    "scan_json_payloads_quiz",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN event_id + 1 END AS session_id,
    CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS n_answers, CASE event_id % 3 WHEN 0 THEN event_type END AS question,
    CASE WHEN event_id % 3 = 2 THEN 'Invalid JSON format' END AS reason FROM events""",
)
def scan_json_payloads_quiz(spark, folder):
    """Bodies of submitted quizzes; a body without answers counts as one with none."""
    body = """CASE event_id % 3 WHEN 0 THEN concat('{"session_id": ', event_id, ', "answers": [1, null], "quiz_data": {"questions": [{"question": "', event_type, '", "options": ["a"], "correct_answer": 0}]}}')
      WHEN 1 THEN concat('{"session_id": ', event_id + 1, '}') ELSE '["answers"' END"""
    bodies = table(spark, folder, "events").select("event_id", F.expr(body).alias("body"))
    judged = payloads.judge_payloads(bodies, QUIZ_SUBMISSION_PAYLOAD)
    taken = F.col("reason").isNull()
    return judged.select(
        "event_id", "payload.session_id",
        F.when(taken, F.size(F.coalesce("payload.answers", F.array().cast("array<int>"))).cast("long")).alias("n_answers"),
        F.get("payload.quiz_data.questions", F.lit(0))["question"].alias("question"), "reason",
    )


@query(
    "scan_json_payloads_chat",
    """SELECT event_id, CASE event_id % 6 WHEN 5 THEN 'hi' END AS message,
    CASE event_id % 6 WHEN 2 THEN 'Invalid JSON format' WHEN 4 THEN 'Invalid JSON format' WHEN 5 THEN NULL ELSE 'Empty message' END AS reason FROM events""",
)
def scan_json_payloads_chat(spark, folder):
    bodies = table(spark, folder, "events").select("event_id", F.expr(_BODY).alias("body"))
    judged = payloads.judge_payloads(bodies, CHAT_PAYLOAD, "message")
    return judged.select("event_id", F.when(F.col("reason").isNull(), F.col("payload.message")).alias("message"), "reason")


@query(
    "scan_entities",
    "SELECT id, user_id, topic, activity_type, start_time, duration_seconds, score, CAST(NULL AS TIMESTAMP) AS end_time FROM <fx_sessions> s",
)
def scan_entities(spark, folder):
    root = shared_folder(spark, "entities")
    sinks.append(view(spark, folder, "fx_sessions"), f"{root}/learning_sessions")
    return entities.read_entity(spark, root, "learning_sessions").drop("metadata")


@query(
    "sink_append",
    "SELECT id, user_id, topic, reviewed FROM <fx_mistakes> m UNION ALL SELECT id, user_id, topic, true FROM <fx_sessions> s",
)
def sink_append(spark, folder):
    root = shared_folder(spark, "append")
    sinks.append(view(spark, folder, "fx_mistakes").select("id", "user_id", "topic", "reviewed"), root)
    extra = view(spark, folder, "fx_sessions").select("id", "user_id", "topic", F.lit(True).alias("reviewed"))
    sinks.append(extra, root)
    return spark.read.parquet(root)


@query(
    "sink_insert_if_absent",
    """WITH fresh AS (SELECT user_id % 10 AS room_id, user_id, min(ts) AS joined_at FROM events WHERE event_type <> 'view' GROUP BY user_id
      UNION ALL SELECT 100 + user_id % 10, user_id, min(ts) FROM events WHERE event_type IN ('view', 'error') GROUP BY user_id)
    SELECT p.room_id, p.user_id, p.joined_at, p.is_active OR f.user_id IS NOT NULL AS is_active FROM <fx_participants> p LEFT JOIN fresh f ON f.room_id = p.room_id AND f.user_id = p.user_id
    UNION ALL SELECT room_id, user_id, joined_at, true FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM <fx_participants> p WHERE p.room_id = f.room_id AND p.user_id = f.user_id)""",
)
def sink_insert_if_absent(spark, folder):
    events = table(spark, folder, "events")
    room = F.col("user_id") % 10
    joins = events.where("event_type <> 'view'").select(room.alias("room_id"), "user_id", F.col("ts").alias("joined_at"))
    others = events.where("event_type IN ('view', 'error')").select((room + 100).alias("room_id"), "user_id", F.col("ts").alias("joined_at"))
    fresh = joins.unionByName(others).withColumn("is_active", F.lit(True))
    merged = sinks.insert_if_absent(view(spark, folder, "fx_participants"), fresh, ["room_id", "user_id"], "is_active")
    return sinks.write_snapshot(merged, shared_folder(spark, "participants"))


_DELETED = """WITH gone AS (SELECT e.id FROM <fx_exercises> e WHERE EXISTS (SELECT 1 FROM events v WHERE v.event_id = e.id AND v.user_id % 97 = e.created_by))"""


@query(
    "sink_owner_delete",
    f"""{_DELETED} SELECT 'exercise' AS kind, id FROM <fx_exercises> e WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'attempt', id FROM <fx_attempts> a WHERE exercise_id NOT IN (SELECT id FROM gone)""",
)
def sink_owner_delete(spark, folder):
    """Requests to delete exercises, most of them by users who do not own them."""
    requests = table(spark, folder, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 97).alias("user_id"))
    parent = view(spark, folder, "fx_exercises").withColumnRenamed("created_by", "owner_id")
    left = sinks.delete_owned(parent, requests, {"attempts": (view(spark, folder, "fx_attempts"), "exercise_id")})
    return (
        left["parent"].select(F.lit("exercise").alias("kind"), "id")
        .unionByName(left["attempts"].select(F.lit("attempt").alias("kind"), "id"))
    )


_BEST_SQL = f"""{_DELETED}, lost AS (SELECT id FROM <fx_attempts> a WHERE exercise_id IN (SELECT id FROM gone)),
best AS (SELECT user_id, min(id) AS best FROM <fx_attempts> a WHERE status = 'success' GROUP BY user_id)
SELECT p.id, p.user_id, p.exercise_id, CASE WHEN b.best NOT IN (SELECT id FROM lost) THEN b.best END AS best_submission
FROM <fx_progress> p LEFT JOIN best b ON b.user_id = p.user_id WHERE p.exercise_id NOT IN (SELECT id FROM gone)"""


@query("sink_owner_delete_best", _BEST_SQL)
def sink_owner_delete_best(spark, folder):
    """Deleted exercises take attempts and progress with them; other progress forgets a best attempt that is gone.

    Here the best attempt of a user is the first successful one on any exercise.
    """
    requests = table(spark, folder, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 97).alias("user_id"))
    exercises = view(spark, folder, "fx_exercises").withColumnRenamed("created_by", "owner_id")
    attempts = view(spark, folder, "fx_attempts")
    best = attempts.where("status = 'success'").groupBy("user_id").agg(F.min("id").alias("best_submission"))
    progress = view(spark, folder, "fx_progress").join(best, "user_id", "left").select("id", "user_id", "exercise_id", "best_submission")
    left = sinks.delete_owned(exercises, requests, {"attempts": (attempts, "exercise_id"), "progress": (progress, "exercise_id")})
    lost = attempts.select("id").join(left["attempts"].select("id"), "id", "left_anti")
    return sinks.forget_best(left["progress"], lost)


_CLOSED = """WITH gone AS (SELECT r.id FROM <fx_rooms> r WHERE r.id % 3 = 0 AND EXISTS (SELECT 1 FROM events v WHERE v.user_id = r.host_id AND v.event_type = 'error'))"""


@query(
    "sink_owner_delete_room",
    f"""{_CLOSED} SELECT 'room' AS kind, id AS room_id, 0 AS user_id FROM <fx_rooms> r WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'player', room_id, user_id FROM <fx_participants> p WHERE room_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'question', room_id, question_number FROM <fx_questions> q WHERE room_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'answer', room_id, user_id FROM <fx_answers> a WHERE room_id NOT IN (SELECT id FROM gone)""",
)
def sink_owner_delete_room(spark, folder):
    """Errors of users ask to delete the rooms they host and others; all that hangs on a room goes with it."""
    asked = table(spark, folder, "events").where("event_type = 'error'").select("user_id").distinct()
    rooms = view(spark, folder, "fx_rooms").withColumnRenamed("host_id", "owner_id")
    requests = asked.select(F.explode(F.expr("sequence(0L, 9L, 3L)")).alias("id"), "user_id")
    children = {name: (view(spark, folder, f"fx_{name}"), "room_id") for name in ("participants", "questions", "answers")}
    left = sinks.delete_owned(rooms, requests, children)
    rows = [
        left["parent"].select(F.lit("room").alias("kind"), F.col("id").alias("room_id"), F.lit(0).alias("user_id")),
        left["participants"].select(F.lit("player"), "room_id", "user_id"),
        left["questions"].select(F.lit("question"), "room_id", "question_number"),
        left["answers"].select(F.lit("answer"), "room_id", "user_id"),
    ]
    return functools.reduce(DataFrame.union, rows).select("kind", F.col("room_id").cast("long"), F.col("user_id").cast("long"))


@query(
    "sink_counter_increment",
    """SELECT c.id, c.id % 5 + coalesce(n, 0) AS view_count FROM <fx_courses> c LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id) v ON v.user_id = c.id""",
)
def sink_counter_increment(spark, folder):
    base = view(spark, folder, "fx_courses").select("id", (F.col("id") % 5).alias("view_count"))
    views = table(spark, folder, "events").where("event_type = 'view'")
    counted = sinks.apply_counts(base, views, "user_id", "view_count")
    return sinks.write_snapshot(counted, shared_folder(spark, "counters"))
