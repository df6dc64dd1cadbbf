"""Parts of markdown answers and courses: code, headings, lists, tables.

Documents have ``text`` and any id columns, which are kept. ``chat`` selects
the rules of chat answers where they differ from those of courses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# The patterns that make up the markdown subset.
COURSE_FENCE = r"```(\w+)?\n?([\s\S]*?)```"
CHAT_FENCE = r"```(\w+)?\n([\s\S]*?)```"
COURSE_LANGUAGE = "code"
CHAT_LANGUAGE = "txt"
HEADING = r"(?m)^(#{1,5}) (.*)$"
CHAT_HEADING = r"(?m)^(#{1,3}) (.*)$"
BULLET = r"(?m)^[\-\*\+•] (.+)$"
CHAT_BULLET = r"(?:^|\n)[\*-]\s+(.+)"
CHAT_NUMBERED = r"(?:^|\n)\d+\.\s+(.+)"
# One header line, a rule line, and body lines; the body is taken whole
# (possessive), so long tables need no backtracking.
TABLE = r"(\|[^\n]+)\n\|(?:\s*[-:]+\s*\|)+\n((?:\|[^\n]+\n)++)"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _without_code(text: Column, chat: bool) -> Column:
    return F.regexp_replace(text, CHAT_FENCE if chat else COURSE_FENCE, "<code>")


def _ids(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "text"]


def code_blocks(docs: DataFrame, chat: bool = False) -> DataFrame:
    """Fenced blocks with language and code; courses trim the code."""
    fence = CHAT_FENCE if chat else COURSE_FENCE
    pairs = F.arrays_zip(
        _all(F.col("text"), fence, 1).alias("language"), _all(F.col("text"), fence, 2).alias("code")
    )
    code = F.col("block.code") if chat else strip(F.col("block.code"))
    language = F.coalesce(F.nullif("block.language", F.lit("")), F.lit(CHAT_LANGUAGE if chat else COURSE_LANGUAGE))
    return docs.select(*_ids(docs), F.posexplode(pairs).alias("position", "block")).select(
        *_ids(docs), "position", language.alias("language"), code.alias("code")
    )


def headings(docs: DataFrame, chat: bool = False) -> DataFrame:
    """Heading lines outside code with their level."""
    pattern = CHAT_HEADING if chat else HEADING
    bare = docs.withColumn("text", _without_code(F.col("text"), chat))
    pairs = F.arrays_zip(
        _all(F.col("text"), pattern, 1).alias("marks"), _all(F.col("text"), pattern, 2).alias("title")
    )
    return bare.select(*_ids(docs), F.posexplode(pairs).alias("position", "h")).select(
        *_ids(docs), "position", F.length("h.marks").alias("level"), "h.title"
    )


def list_items(docs: DataFrame, chat: bool = False) -> DataFrame:
    """List items outside code; chat answers also have numbered ones."""
    bare = docs.withColumn("text", _without_code(F.col("text"), chat))
    kinds = [("bullet", CHAT_BULLET), ("numbered", CHAT_NUMBERED)] if chat else [("bullet", BULLET)]
    found = F.flatten(F.array(*[_numbered(kind, _all(F.col("text"), pattern, 1)) for kind, pattern in kinds]))
    return bare.select(*_ids(docs), F.explode(found).alias("i")).select(*_ids(docs), "i.*")


def _numbered(kind: str, items: Column) -> Column:
    return F.transform(
        items, lambda item, i: F.struct(F.lit(kind).alias("kind"), i.alias("position"), item.alias("item"))
    )


def _cells(row: Column) -> Column:
    return F.transform(F.filter(F.split(row, r"\|"), lambda c: c != ""), strip)


def md_tables(docs: DataFrame) -> DataFrame:
    """Pipe tables: header cells and rows of cells, empty cells dropped."""
    pairs = F.arrays_zip(
        _all(F.col("text"), TABLE, 1).alias("header"), _all(F.col("text"), TABLE, 2).alias("body")
    )
    bare = docs.withColumn("text", _without_code(F.col("text"), True))
    return bare.select(*_ids(docs), F.posexplode(pairs).alias("position", "t")).select(
        *_ids(docs),
        "position",
        _cells(F.col("t.header")).alias("header"),
        F.transform(F.split(strip(F.col("t.body")), "\n"), _cells).alias("rows"),
    )
