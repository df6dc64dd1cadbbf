"""Generated exercise text to exercises, in three stages.

Stage 1 parses the JSON after cleaning it, stage 2 picks the fields one by one,
stage 3 is a placeholder. Rows have ``text`` and ``topic``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext
from ..functions.text import strip
from ..schemas import TEST
from .staging import hold, spread

# Markers, required keys and placeholder texts.
JSON_FENCE = "```json"
REQUIRED = ["title", "description", "starter_code", "solution", "tests"]
STRING_FIELD = r'"([^"]*(?:\\.[^"]*)*)"'
DEFAULT_TEST = ("my_function()", "Hello World")
STUB = "\n\ndef my_function():\n    # Your code here\n    pass"
SAMPLE_LEAD = "# Example solution for "
SAMPLE = "\n\ndef my_function():\n    return 'Hello World'"


def _placeholders(from_course: bool) -> dict[str, Column]:
    topic = F.col("topic")
    if from_course:
        return {
            "title": F.concat(F.lit("Practical exercise: "), topic),
            "description": F.concat(
                F.lit("Practical exercise based on the course '"),
                topic,
                F.lit("'. Complete the code below to practice the learned concepts."),
            ),
            "starter_code": F.concat(
                F.lit("# Exercise based on course: "), topic, F.lit("\n# TODO: Implement your solution" + STUB)
            ),
            "solution": F.concat(F.lit(SAMPLE_LEAD), topic, F.lit(SAMPLE)),
        }
    return {
        "title": F.concat(F.lit("Exercise on "), topic),
        "description": F.concat(F.lit("Practical exercise on "), topic),
        "starter_code": F.concat(F.lit("# TODO: Implement your solution for "), topic, F.lit(STUB)),
        "solution": F.concat(F.lit(SAMPLE_LEAD), topic, F.lit(SAMPLE)),
    }


def _default_tests() -> Column:
    call, result = DEFAULT_TEST
    return F.array(F.struct(F.lit(call).alias("input"), F.lit(result).alias("expected")))


def json_part(text: Column) -> Column:
    """The JSON inside the text: fenced as json, else from the first to the last brace.

    Null when there is neither a fence nor an opening brace.
    """
    body = strip(text)
    fenced = strip(F.regexp_extract(body, r"(?s)```json(.*?)(?:```|\z)", 1))
    opening = F.instr(body, F.lit("{"))
    closing = F.length(body) - F.instr(F.reverse(body), F.lit("}")) + 1
    braced = F.when(
        body.contains("}") & (closing >= opening),
        F.substring(body, opening, F.greatest(closing - opening + 1, F.lit(0))),
    ).otherwise("")
    return F.when(body.contains(JSON_FENCE), fenced).when(opening > 0, braced)


def escape_values() -> Column:
    """The text of ``__pieces`` with line breaks and tabs inside string values escaped.

    The pieces are the text cut at its quotes; a value is the piece after a
    lone colon that follows a non-empty key.
    """

    def mend(piece, i):
        after_colon = F.get(F.col("__pieces"), i - 1).rlike(r"^:\s*\z")
        named = F.coalesce(F.get(F.col("__pieces"), i - 2), F.lit("")) != ""
        fixed = piece
        for char, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            fixed = F.replace(fixed, F.lit(char), F.lit(code))
        # The last piece is followed by no quote, so it is not a value.
        closed = i < F.size(F.col("__pieces")) - 1
        return F.when((i >= 2) & closed & named & F.coalesce(after_colon, F.lit(False)), fixed).otherwise(piece)

    return F.array_join(F.transform("__pieces", mend), '"')


def _clean_code(code: Column) -> Column:
    bare = F.replace(F.replace(code, F.lit('"""'), F.lit("")), F.lit("'''"), F.lit(""))
    return F.replace(F.replace(strip(bare), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))


def _picked(text: Column, key: str, dotall: bool) -> Column:
    flag = "(?s)" if dotall else ""
    pattern = f'{flag}"{key}":\\s*{STRING_FIELD}'
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def _picked_code(text: Column, key: str) -> Column:
    fence = f'(?s)"{key}":\\s*```python\\n(.*?)```'
    fenced = F.when(text.rlike(fence), F.regexp_extract(text, fence, 1))
    return F.coalesce(_picked(text, key, True), fenced)


def _unescape(code: Column) -> Column:
    for escaped, plain in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"')):
        code = F.replace(code, F.lit(escaped), F.lit(plain))
    return code


def repair_stage1(texts: DataFrame, from_course: bool = False) -> DataFrame:
    """Add ``parsed``: the exercise as a struct, null where the JSON cannot be read."""
    json = F.col("__json")
    plain = json_part(F.col("text"))
    quotes = F.replace(F.replace(plain, F.lit('"""'), F.lit('"')), F.lit("'''"), F.lit('"'))
    staged = hold(texts, "__json", quotes)
    if from_course:
        # Here only the last line break of a value is escaped.
        staged = hold(staged, "__json", F.regexp_replace(json, r':\s*"([^"]*)\n([^"]*)"', ': "$1\\\\n$2"'))
    else:
        pieces = hold(staged, "__pieces", F.split(json, '"'))
        staged = hold(pieces, "__json", escape_values()).drop("__pieces")
    row = F.col("__row")
    complete = F.size(F.array_intersect(F.json_object_keys("__json"), F.array(*[F.lit(k) for k in REQUIRED]))) == len(
        REQUIRED
    )
    parsed = F.struct(
        row["title"].alias("title"),
        row["description"].alias("description"),
        _clean_code(row["starter_code"]).alias("starter_code"),
        _clean_code(row["solution"]).alias("solution"),
        jsontext.parse_array(row["tests"], TEST).alias("tests"),
    )
    fields = ", ".join(f"{k} string" for k in REQUIRED)
    read = hold(staged, "__row", jsontext.parse(json, fields))
    return hold(read, "parsed", F.when(row.isNotNull() & complete, parsed)).drop("__json", "__row")


def repair_stage2(texts: DataFrame, from_course: bool = False) -> DataFrame:
    """Add ``picked``: the exercise from single fields, defaults where one is missing."""
    text, spare = F.col("text"), _placeholders(from_course)
    pattern = r'(?s)"tests":\s*\[(.*?)\]'
    listed = F.when(text.rlike(pattern), F.concat(F.lit("["), F.regexp_extract(text, pattern, 1), F.lit("]")))
    picked = F.struct(
        F.coalesce(_picked(text, "title", False), spare["title"]).alias("title"),
        F.coalesce(_picked(text, "description", False), spare["description"]).alias("description"),
        _unescape(F.coalesce(_picked_code(text, "starter_code"), spare["starter_code"])).alias("starter_code"),
        _unescape(F.coalesce(_picked_code(text, "solution"), spare["solution"])).alias("solution"),
        F.coalesce(jsontext.parse_array(listed, TEST), _default_tests()).alias("tests"),
    )
    return texts.withColumn("picked", picked)


def repair_fallback(texts: DataFrame, from_course: bool = False) -> DataFrame:
    """Add ``spare``: the placeholder exercise of each topic."""
    words = _placeholders(from_course)
    if not from_course:
        words["description"] = F.concat(words["description"], F.lit(". Complete the code below."))
    spare = F.struct(
        words["title"].alias("title"),
        words["description"].alias("description"),
        F.concat(words["starter_code"], F.lit("\n")).alias("starter_code"),
        F.concat(words["solution"], F.lit("\n")).alias("solution"),
        _default_tests().alias("tests"),
    )
    return texts.withColumn("spare", spare)


def repair(texts: DataFrame, from_course: bool = False) -> DataFrame:
    """Exercises from generated texts, with the stage that gave them."""
    texts = spread(texts)
    readable = F.col("text").contains("{") | F.col("text").contains(JSON_FENCE)
    staged = repair_fallback(repair_stage2(repair_stage1(texts, from_course), from_course), from_course)
    stage = F.when(F.col("parsed").isNotNull(), 1).when(readable, 2).otherwise(3)
    chosen = (
        F.when(F.col("stage") == 1, F.col("parsed"))
        .when(F.col("stage") == 2, F.col("picked"))
        .otherwise(F.col("spare"))
    )
    # held, so the later stages run once, and only for the rows that need them
    return hold(staged.withColumn("stage", stage), "exercise", chosen).select(*texts.columns, "stage", "exercise.*")
