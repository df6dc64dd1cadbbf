"""Text shaping shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that end a line, and characters that count as blank.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
MODULE_NAMES = {
    "python": "Python - Complete",
    "javascript": "JavaScript - Complete",
    "react": "React - Framework",
    "django": "Django - Framework",
    "fastapi": "FastAPI - Framework",
    "sql": "SQL - Databases",
    "docker": "Docker - Containerization",
    "git": "Git - Version Control",
}
DEFAULT_LANGUAGE = "fr"
DEFAULT_QUESTIONS = 10

MAX_INT = 2147483647


def strip(col: Column) -> Column:
    """Drop all white space at both ends (plain ``trim`` drops blanks only)."""
    return F.btrim(col, F.lit(BLANKS))


def lines(col: Column) -> Column:
    """Array of lines, split at every kind of line end."""
    # All line ends become one character first: splitting at it needs no regex.
    unix = F.replace(col, F.lit("\r\n"), F.lit("\n"))
    return F.split(F.translate(unix, LINE_ENDS, "\n" * len(LINE_ENDS)), "\n")


def truncate(col: Column, size: int = 30) -> Column:
    """Longer texts become their first ``size`` characters and an ellipsis."""
    return F.when(F.length(col) > size, F.concat(F.substring(col, 1, size), F.lit("..."))).otherwise(col)


def hours_minutes(minutes: Column) -> Column:
    """Minutes as ``"2h 05m"``."""
    whole = minutes.cast("long")
    return F.concat(
        F.floor(whole / 60).cast("string"),
        F.lit("h "),
        F.lpad((whole % 60).cast("string"), 2, "0"),
        F.lit("m"),
    )


def title_case(col: Column) -> Column:
    """Capital after every character that is not a letter, lower case elsewhere."""
    # The split keeps each run of letters with the non-letters after it, so a
    # capital is due exactly at the start of every piece.
    pieces = F.split(col, r"(?<=\P{L})(?=\p{L})")
    cased = F.transform(
        pieces,
        lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, MAX_INT))),
    )
    return F.array_join(cased, "")


def module_display_name(key: Column) -> Column:
    """Fixed names for known modules, else the key in title case."""
    known = F.create_map(*[F.lit(x) for pair in MODULE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), title_case(F.replace(key, F.lit("_"), F.lit(" "))))


def module_description(first_sections: Column, count: Column) -> Column:
    """First three sections in title case, and how many more there are."""
    shown = F.transform(
        F.slice(first_sections, 1, 3), lambda s: title_case(F.replace(s, F.lit("_"), F.lit(" ")))
    )
    rest = count - 3
    more = F.when(rest > 0, F.concat(F.lit(" and "), rest.cast("string"), F.lit(" other sections")))
    return F.when(count == 0, F.lit("Empty module")).otherwise(
        F.concat(F.array_join(shown, ", "), F.coalesce(more, F.lit("")))
    )


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_name(path: Column) -> Column:
    """Name of the folder a file lies in."""
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def suffix(name: Column) -> Column:
    """Text after the last dot, without it; empty for names that only start with a dot."""
    return F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1)


def stem(name: Column) -> Column:
    """File name without its suffix."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1")


def language(preference: Column) -> Column:
    return F.coalesce(preference, F.lit(DEFAULT_LANGUAGE))


def clamp_questions(text: Column) -> Column:
    """Number of questions asked for; 10 unless it is a whole number from 1 to 50.

    Underscores may stand between digits.
    """
    digits = F.regexp_extract(strip(text), r"^([+-]?[0-9]+(?:_[0-9]+)*)$", 1)
    number = F.replace(digits, F.lit("_"), F.lit("")).try_cast("int")
    return F.when(number.between(1, 50), number).otherwise(F.lit(DEFAULT_QUESTIONS))


def answer_text(options: Column, index: Column) -> Column:
    """Text of the chosen option.

    Past the end gives "No answer"; a negative index counts from the end; null
    when the index is missing or below the first option.
    """
    size = F.size(options)
    position = F.when(index < 0, index).otherwise(index + 1)
    return (
        F.when(index >= size, F.lit("No answer"))
        .when(index.isNull() | (index < -size), F.lit(None))
        .otherwise(F.try_element_at(options, position.cast("int")))
    )


def letter_index(letter: Column) -> Column:
    """A to D as 0 to 3; -1 for anything that is not part of "ABCD"."""
    return F.instr(F.lit("ABCD"), letter) - 1


def course_title(content: Column, fallback: Column) -> Column:
    """First top-level heading, else the fallback."""
    found = F.regexp_extract(content, r"(?md)^# (.+)$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), fallback)


def session_topic(question: Column) -> Column:
    return F.substring(question, 1, 100)


def contains_folded(col: Column, needle: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(col).contains(needle.lower())
