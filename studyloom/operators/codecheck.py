"""Static check of submitted code, and grading of recorded test runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .staging import hold

# The code policy.
FORBIDDEN_MODULES = [
    "os", "subprocess", "socket", "urllib", "requests", "shutil", "glob", "pickle", "marshal",
    "shelve", "dbm", "sqlite3", "threading", "multiprocessing", "ctypes", "importlib", "eval",
    "exec", "compile", "open", "file", "input", "raw_input",
]
SAFE_MODULES = ["time", "functools"]
DANGEROUS_WORDS = ["exec", "eval", "compile", "open", "file"]
EXPECTED_ERRORS = ["TypeError", "ValueError", "Exception"]


def _contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def _found(words: list[str], test) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in sorted(words)]), test)


def policy_scan(submissions: DataFrame) -> DataFrame:
    """Forbidden imports and words in ``code``, and the verdict.

    An import line that names an allowed module anywhere passes as a whole.
    Imports are judged before words. All hits are listed, sorted.
    """
    lines = F.transform(F.split("code", "\n"), strip)
    imports = F.filter(
        lines,
        lambda ln: (ln.startswith("import ") | ln.startswith("from ")) & ~_contains_any(ln, SAFE_MODULES),
    )
    verdict = (
        F.when(F.size("forbidden_imports") > 0, "import")
        .when(F.size("forbidden_words") > 0, "word")
        .otherwise("clean")
    )
    return (
        hold(submissions, "__imports", imports)
        .withColumn(
            "forbidden_imports",
            _found(FORBIDDEN_MODULES, lambda m: F.exists("__imports", lambda ln: ln.contains(m))),
        )
        .withColumn("forbidden_words", _found(DANGEROUS_WORDS, lambda w: F.col("code").contains(w)))
        .withColumn("verdict", verdict)
        .drop("__imports")
    )


def with_test_call(code: Column, call: Column) -> Column:
    """The program a test runs: the submitted code and the call, which the policy covers as well."""
    return F.concat(code, F.lit("\n\nresult = "), call, F.lit("\nif result is not None:\n    print(result)\n"))


def grade_runs(runs: DataFrame) -> DataFrame:
    """Grade recorded runs: success, output, error, exception_type, expected."""
    expected = strip(F.col("expected"))
    output = strip(F.col("output"))
    shown = F.filter(F.transform(F.split(output, "\n"), strip), lambda ln: (ln != "") & (ln != "None"))
    printed = F.coalesce(F.get(shown, F.lit(0)), output)
    raised = F.coalesce(F.col("exception_type"), F.lit(""))
    named = {e: F.col("expected").contains(e) for e in EXPECTED_ERRORS}
    awaited = named["TypeError"] | named["ValueError"] | named["Exception"]
    fits = (
        (named["TypeError"] & (raised == "TypeError"))
        | (named["ValueError"] & (raised == "ValueError"))
        | (named["Exception"] & raised.isin(EXPECTED_ERRORS))
    )
    won = F.col("success")
    passed = F.when(won, printed == expected).otherwise(awaited & fits)
    mismatch = F.concat(F.lit("Attendu: "), expected, F.lit(", Obtenu: "), printed)
    other = F.concat(
        F.lit("Expected error ("),
        expected,
        F.lit(") but got: "),
        F.coalesce(F.nullif(raised, F.lit("")), F.lit("unknown error")),
    )
    return runs.select(
        *[c for c in runs.columns if c not in ("output", "error", "success")],
        passed.alias("passed"),
        F.when(won, printed).when(passed, expected).otherwise("").alias("actual"),
        F.when(passed, "").when(won, mismatch).when(awaited, other).otherwise(F.col("error")).alias("error"),
    )
