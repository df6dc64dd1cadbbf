"""Generated quiz text to questions, quiz grading and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as txt
from .staging import hold

# Markers of the generated text, and the placeholder question.
QUESTION_MARK = r"\nQ\p{Nd}+\."
OPTION_LINE = r"^[A-D]\. "
ANSWER_MARKS = ["answer:", "réponse:"]
EXPLANATION_MARKS = ["explanation:", "explication:"]
PLACEHOLDER = {
    "fr": ("Question d'exemple sur ", "Explication d'exemple"),
    "en": ("Example question on ", "Sample explanation"),
}
PLACEHOLDER_OPTIONS = ["Option A", "Option B", "Option C", "Option D"]
MISTAKE_TYPE = "quiz_wrong_answer"

# Messages after a solo quiz, from 90, 70, 50 and 0 per cent.
FEEDBACK_BANDS = [90, 70, 50]
FEEDBACK = {
    "fr": [
        "🏆 Excellent ! Vous maîtrisez parfaitement le sujet !",
        "👍 Très bien ! Quelques points à revoir mais c'est solide !",
        "📚 Pas mal ! Il reste encore des choses à apprendre.",
        "💪 Continuez vos efforts ! C'est en pratiquant qu'on progresse.",
    ],
    "en": [
        "🏆 Excellent! You have perfect mastery of the subject!",
        "👍 Very good! A few points to review but it's solid!",
        "📚 Not bad! There are still things to learn.",
        "💪 Keep up your efforts! Practice makes perfect.",
    ],
}


def _is_option(line: Column) -> Column:
    return line.rlike(OPTION_LINE)


def _last_value(lines: Column, marks: list[str]) -> Column:
    """Text after the colon of the last line that begins with a mark, or null."""

    def marked(line):
        low = F.lower(line)
        return low.startswith(marks[0]) | low.startswith(marks[1])

    found = F.get(F.reverse(F.filter(lines, marked)), F.lit(0))
    return txt.strip(F.regexp_replace(found, r"(?s)^[^:]*:", ""))


def _question(block: Column) -> Column:
    return F.struct(
        txt.strip(F.array_join(block["head"], "\n")).alias("question"),
        F.transform(
            F.filter(block["tail"], _is_option), lambda o: txt.strip(F.substring(o, 4, txt.MAX_INT))
        ).alias("options"),
        F.upper(_last_value(block["tail"], ANSWER_MARKS)).alias("letter"),
        F.coalesce(_last_value(block["tail"], EXPLANATION_MARKS), F.lit("")).alias("explanation"),
    )


def _bared(lines: Column) -> Column:
    return F.struct(lines.alias("lines"), F.transform(lines, txt.strip).alias("bare"))


def _located(block: Column) -> Column:
    """Adds the place of the first option, 0 without one."""
    at = F.array_position(F.transform(block["bare"], _is_option), True).cast("int")
    return F.struct(block["lines"].alias("lines"), block["bare"].alias("bare"), at.alias("at"))


def _halves(block: Column) -> Column:
    """Lines before the first option (head), and stripped ones from it on (tail)."""
    at, lines, bare = block["at"], block["lines"], block["bare"]
    return F.struct(
        F.when(at == 0, lines).otherwise(F.slice(lines, 1, F.greatest(at - 1, F.lit(0)))).alias("head"),
        F.when(at == 0, F.slice(bare, 1, 0))
        .otherwise(F.slice(bare, F.greatest(at, F.lit(1)), F.size(bare)))
        .alias("tail"),
    )


def parse_quiz(texts: DataFrame) -> DataFrame:
    """Add ``questions`` (array of structs) and ``failed`` to rows with ``text``.

    A question with options but without an answer line fails its whole quiz,
    which then has no questions. All of it happens inside the row: no shuffle.
    """
    blocks = F.split(F.concat(F.lit("\n"), txt.strip(F.col("text"))), QUESTION_MARK)
    lines = F.transform(F.slice(blocks, 2, F.size(blocks)), lambda b: txt.lines(txt.strip(b)))
    # One step per transform: each uses the outcome of the one before, once.
    parts = F.transform(F.transform(F.transform("__lines", _bared), _located), _halves)

    def complete(q):
        return (q["question"] != "") & (F.size(q["options"]) > 0)

    failed = F.exists("__raw", lambda q: complete(q) & q["letter"].isNull())
    kept = F.filter("__raw", lambda q: ~F.col("failed") & complete(q) & F.lit("ABCD").contains(q["letter"]))
    shaped = F.transform(
        kept,
        lambda q: F.struct(
            q["question"].alias("question"),
            q["options"].alias("options"),
            txt.letter_index(q["letter"]).alias("correct_answer"),
            q["explanation"].alias("explanation"),
        ),
    )
    cut = hold(hold(texts, "__lines", lines), "__parts", parts)
    read = hold(hold(cut, "__raw", F.transform("__parts", _question)), "failed", failed)
    return hold(read, "questions", shaped).drop("__lines", "__parts", "__raw")


def with_fallback(parsed: DataFrame) -> DataFrame:
    """Give quizzes without questions the placeholder, in French or else in English."""

    def placeholder(language):
        lead, explanation = PLACEHOLDER[language]
        return F.struct(
            F.concat(F.lit(lead), F.col("topic")).alias("question"),
            F.array(*[F.lit(o) for o in PLACEHOLDER_OPTIONS]).alias("options"),
            F.lit(0).alias("correct_answer"),
            F.lit(explanation).alias("explanation"),
        )

    spare = F.array(F.when(F.col("language") == "fr", placeholder("fr")).otherwise(placeholder("en")))
    return parsed.withColumn("is_fallback", F.size("questions") == 0).withColumn(
        "questions", F.when(F.col("is_fallback"), spare).otherwise(F.col("questions"))
    )


def question_rows(parsed: DataFrame) -> DataFrame:
    """One row per question, numbered from 1 inside its quiz."""
    return parsed.select("*", F.posexplode("questions").alias("__pos", "__q")).select(
        *[c for c in parsed.columns if c not in ("questions", "text")],
        (F.col("__pos") + 1).alias("question_number"),
        "__q.*",
    )


def grade_quiz(submissions: DataFrame) -> DataFrame:
    """Grade quiz submissions (``answers``, ``questions``) in the row.

    ``ok`` is false, and score and mistakes are null, when there are no
    questions, more answers than questions, or an answer that points to no
    option. Unanswered questions count as wrong without a mistake.
    """
    total = F.size("questions")

    def is_wrong(given):
        key = F.get(F.col("questions"), given["place"])["correct_answer"]
        return ~F.coalesce(given["answer"] == key, F.lit(False))

    def mistake(given):
        q = F.get(F.col("questions"), given["place"])
        past = q["correct_answer"] >= F.size(q["options"])
        return F.struct(
            q["question"].alias("question"),
            txt.answer_text(q["options"], given["answer"]).alias("user_answer"),
            F.when(~past, txt.answer_text(q["options"], q["correct_answer"])).alias("correct_answer"),
        )

    given = F.transform("answers", lambda a, i: F.struct(i.alias("place"), a.alias("answer")))
    broken = F.exists("__wrong", lambda m: m["user_answer"].isNull() | m["correct_answer"].isNull())
    ok = (total > 0) & (F.size("answers") <= total) & ~broken
    right = F.size("answers") - F.size("__wrong")
    judged = hold(submissions, "__wrong", F.transform(F.filter(given, is_wrong), mistake))
    return (
        judged.withColumn("ok", F.coalesce(ok, F.lit(False)))
        .withColumn("correct_answers", F.when(F.col("ok"), right))
        .withColumn("total_questions", total)
        .withColumn("score", F.when(F.col("ok"), right / F.nullif(total, F.lit(0)) * 100))
        .withColumn("mistakes", F.when(F.col("ok"), F.col("__wrong")))
        .drop("__wrong")
    )


def quiz_mistakes(graded: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """One row per wrong answer.

    ``topic`` is the session id as text; with ``sessions`` (id, topic) the real
    topic is added as ``session_topic``.
    """
    rows = graded.where("ok").select("session_id", "user_id", F.posexplode("mistakes").alias("place", "m")).select(
        "session_id",
        "user_id",
        "place",
        F.col("session_id").cast("string").alias("topic"),
        F.lit(MISTAKE_TYPE).alias("mistake_type"),
        "m.question",
        "m.user_answer",
        "m.correct_answer",
    )
    if sessions is None:
        return rows
    names = sessions.select(F.col("id").alias("session_id"), F.col("topic").alias("session_topic"))
    return rows.join(names, "session_id", "left")


def quiz_feedback(results: DataFrame) -> DataFrame:
    """Percentage and message for rows with ``correct``, ``total`` and ``language``."""
    percent = F.floor(F.col("correct") / F.nullif("total", F.lit(0)) * 100 + 0.5)
    french = F.coalesce(F.col("language"), F.lit("")) == "fr"
    chain = None
    for i, lower in enumerate(FEEDBACK_BANDS):
        message = F.when(french, FEEDBACK["fr"][i]).otherwise(FEEDBACK["en"][i])
        chain = (F if chain is None else chain).when(F.col("percentage") >= lower, message)
    last = F.when(french, FEEDBACK["fr"][-1]).otherwise(FEEDBACK["en"][-1])
    return results.withColumn("percentage", percent).withColumn("message", chain.otherwise(last))
