"""Edge cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from studyloom.functions import gamify, jsontext, text


def values(spark, column, rows, kind):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("x"))).collect()]


def test_levels(spark):
    xp = [0, 99, 100, 299, 300, 599, 600, 1000, 1500, 2100, 2800, 3600, 4499, 4500, 5499, 5500, 44499, 44500, 99999]
    assert values(spark, gamify.level, xp, "long") == [1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8, 9, 9, 10, 10, 11, 49, 50, 50]


def test_level_bounds(spark):
    assert values(spark, gamify.xp_for_next_level, [0, 4499, 4500, 5500, 99999], "long") == [100, 4500, 5500, 6500, 45500]
    assert values(spark, gamify.xp_for_current_level, [0, 100, 4500, 5500], "long") == [0, 100, 4500, 5500]
    assert values(spark, gamify.xp_progress_percentage, [200, 99999, 0], "long") == [50.0, 100.0, 0.0]
    assert values(spark, gamify.xp_in_level, [99999], "long") == [99999 - 44500]
    assert values(spark, gamify.xp_needed, [200, 4600], "long") == [200, 1000]


def test_titles(spark):
    levels = [1, 2, 3, 5, 8, 12, 20, 30, 31, 50]
    expected = "Beginner Apprentice Apprentice Student Developer Expert Master Sage Legend Legend".split()
    assert values(spark, gamify.level_title, levels, "int") == expected


def test_awards(spark):
    rows = [
        ("course_generation", None, None, 9, 15),
        ("course_save", None, None, 9, 10),
        ("exercise_completion", "advanced", None, 9, 30),
        ("exercise_completion", "beginner", None, 9, 20),
        ("quiz_completion", None, 80.0, 3, 24),
        ("quiz_completion", None, 100.0, 15, 40),
        ("quiz_completion", None, 99.9, 0, 19),
        ("other", None, None, 3, 0),
    ]
    frame = spark.createDataFrame(rows, "a string, d string, s double, b int, want int")
    award = gamify.xp_award(F.col("a"), F.col("d"), F.col("s"), F.col("b"))
    assert [tuple(r) for r in frame.where(award != F.col("want")).collect()] == []


def test_podium(spark):
    assert values(spark, gamify.podium_xp, [1, 2, 3, 4, 5, 6], "int") == [50, 40, 30, 20, 10, 10]


def test_answer_points(spark):
    rows = [(True, 0.0, 1500), (True, 30.0, 1250), (True, 60.0, 1000), (True, 75.0, 1000), (True, -6.0, 1550), (False, 0.0, 0)]
    frame = spark.createDataFrame(rows, "ok boolean, t double, want int")
    got = [r[0] for r in frame.select(gamify.answer_points(F.col("ok"), F.col("t"))).collect()]
    assert got == [r[2] for r in rows]


def test_clamp_questions(spark):
    asked = ["7", "0", "51", "abc", None, " 50 ", "+3", "2.0", "99999999999"]
    assert values(spark, text.clamp_questions, asked, "string") == [7, 10, 10, 10, 10, 50, 3, 10, 10]


def test_answer_text(spark):
    got = values(
        spark, lambda i: text.answer_text(F.array(F.lit("x"), F.lit("y")), i), [5, -1, 0, 1, 2, -2, -3, None], "int"
    )
    assert got == ["No answer", "y", "x", "y", "No answer", "x", None, None]


def test_letters(spark):
    assert values(spark, text.letter_index, ["A", "D", "", "BC", "E"], "string") == [0, 3, 0, 1, -1]


@pytest.mark.parametrize(
    "word", ["c++3d", "01_loops and ifs", "élan vital", "a", "", "x1y2", "HELLO wORLD", "it's ok", "snake_case_name"]
)
def test_title_case_is_pythons(spark, word):
    assert values(spark, text.title_case, [word], "string") == [word.title()]


@pytest.mark.parametrize("word", ["  a b ", "\n\tx　", "\x1c\x85y\xa0", "", " \n "])
def test_strip_is_pythons(spark, word):
    assert values(spark, text.strip, [word], "string") == [word.strip()]


@pytest.mark.parametrize("body", ["a\nb", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e f g", "one"])
def test_lines_are_pythons(spark, body):
    assert values(spark, text.lines, [body], "string") == [body.splitlines()]


def test_module_names(spark):
    got = values(spark, text.module_display_name, ["python", "git", "01_web_dev", "c++3d"], "string")
    assert got == ["Python - Complete", "Git - Version Control", "01 Web Dev", "C++3D"]


def test_module_description(spark):
    def described(names):
        return text.module_description(F.slice(names, 1, 3), F.size(names))

    got = values(spark, described, [["a_b", "c"], ["a", "b", "c", "d", "e"], []], "array<string>")
    assert got == ["A B, C", "A, B, C and 2 other sections", "Empty module"]


def test_durations_and_titles(spark):
    assert values(spark, text.hours_minutes, [0, 61, 600, 605], "int") == ["0h 00m", "1h 01m", "10h 00m", "10h 05m"]
    assert values(spark, text.truncate, ["a" * 30, "b" * 31], "string") == ["a" * 30, "b" * 30 + "..."]


def test_course_title(spark):
    def title(content):
        return text.course_title(content, F.lit("spare"))

    got = values(spark, title, ["# One\n# Two", "text\n# Late\nx", "## No", "#No", "# a\rb\nc"], "string")
    assert got == ["One", "Late", "spare", "spare", "a\rb"]


def test_file_names(spark):
    names = ["a.md", "x.tar.gz", ".hidden", "noext"]
    assert values(spark, text.suffix, names, "string") == ["md", "gz", "", ""]
    assert values(spark, text.stem, names, "string") == ["a", "x.tar", ".hidden", "noext"]
    assert values(spark, text.parent_name, ["/a/b/c.md", "c.md"], "string") == ["b", ""]


@pytest.mark.parametrize(
    "body, good",
    [
        ('{"a": "1"}', True),
        (' {"a": "1"} ', True),
        ('{"a": "1"} x', False),
        ('{"a": "1"}, {"a": "2"}', False),
        ('{"a": "1"}], [{"a": "2"}', False),
        ("{'a': '1'}", False),
        ('{"a": "x\ny"}', False),
        ('{"a": 01}', False),
        ("[1]", False),
        ('[{"a": "1"}]', False),
        ("", False),
        ("null", False),
        (None, False),
    ],
)
def test_json_must_be_one_object(spark, body, good):
    got = values(spark, lambda c: jsontext.parse(c, "a string").isNotNull(), [body], "string")
    assert got == [good]
