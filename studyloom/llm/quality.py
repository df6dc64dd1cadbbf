"""Quality rules as a short-circuit cascade, with built-in functions only.

A rule is a condition on a text and its measures that rejects a document. On a
sample every rule is run by itself: the time it adds is its cost, its outcomes
tell what it rejects. Rules are then put in order greedily: the next one is the
rule that rejects most of what is still there per second. A document is tried
against the rules in that order until one rejects it; the conditions of the
later rules are not evaluated for it.

The order changes the work only, never a verdict: a document is kept when no
rule rejects it. So the sample, whose size is the parameter ``SAMPLE``, and the
clock have no part in the result; only the name of the rejecting rule depends
on them.

Rows: a null text counts as empty. It has no words and falls to the rule
``few_words`` where that is among the rules; a condition that is null does not
reject. Rows without id, rows that share an id and repeated rows are judged one
by one. Every input row gives one output row; other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.operators.staging import hold

from .tables import kept

#: A power of two.
WINDOW_WORDS = 8
#: Expected number of rows on which rules are measured, and how often.
SAMPLE = 2000
ROUNDS = 3
#: The least time a rule is taken to cost, in seconds; below it the clock tells nothing.
LEAST_COST = 0.002


@dataclass(frozen=True)
class Rule:
    """A name and the SQL condition that rejects a document.

    The condition may use the columns of :func:`measured`.
    """

    name: str
    rejects: str


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float


BASE_RULES = [
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
]
RULES = [
    *BASE_RULES,
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("stutter", "4 * size(filter(words, (w, i) -> w = get(words, i - 1))) > n_words"),
    Rule("shouting", "2 * regexp_count(text, '[A-Z]') > word_chars"),
    Rule("exclamations", "5 * regexp_count(text, '!') > n_words"),
    Rule("digits", "5 * regexp_count(text, '[0-9]') > word_chars"),
    Rule("no_letters", "5 * size(filter(words, w -> NOT w RLIKE '[^\\\\x21-\\\\x40\\\\x5B-\\\\x60\\\\x7B-\\\\x7E]')) > n_words"),
]

# Words in windows that occur twice or more: windows are sorted by hash, those
# with an equal neighbour are put back in order of place, and each one counts
# up to the begin of the next.
_COVERED = f"""
CASE WHEN size(windows) = size(array_distinct(windows)) THEN 0L ELSE
  transform(array(sort_array(transform(windows, (h, i) -> struct(h, i)))), s ->
    transform(array(sort_array(transform(filter(s, (x, i) -> x.h = get(s, i - 1).h OR x.h = get(s, i + 1).h), x -> x.i))), p ->
      aggregate(transform(p, (x, i) -> least({WINDOW_WORDS}, coalesce(get(p, i + 1) - x, {WINDOW_WORDS}))), 0L, (a, b) -> a + b)
    )[0]
  )[0]
END"""


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text, words and the measures of every row.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with
    a word), n_dup_lines (equal to an earlier line) and n_repeat_words (words
    in 8-word windows that occur twice or more).
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = hold(rows, "words", F.expr(r"array_remove(split(text, '[\\x20\\x09-\\x0D]+'), '')"))
    rows = hold(rows, "lines", F.expr(r"filter(split(text, '\\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"))
    rows = hold(rows, "hashes", F.expr("transform(words, w -> xxhash64(w))"))
    reach = 1
    while reach < WINDOW_WORDS:
        # the hash of a run of 2 * reach words from those of its halves
        rows = hold(rows, "hashes", F.expr(f"transform(hashes, (h, i) -> xxhash64(h, get(hashes, i + {reach})))"))
        reach *= 2
    rows = hold(rows, "windows", F.expr(f"slice(hashes, 1, greatest(size(hashes) - {WINDOW_WORDS - 1}, 0))")).drop("hashes")
    rows = rows.select(
        "doc_id", "text", "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.expr("CAST(regexp_count(text, '[#*$%&|<>]') AS LONG)").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr("CAST(size(lines) - size(array_distinct(lines)) AS LONG)").alias("n_dup_lines"),
        F.expr(_COVERED).alias("covered"),
    )
    return hold(rows, "n_repeat_words", F.col("covered")).drop("covered")


def estimates(sample: DataFrame, rules: Sequence[Rule]) -> list[Estimate]:
    """Cost in seconds of each rule over a measured sample, and the share it rejects."""

    def seconds(condition: str) -> tuple[float, int, int]:
        best = None
        for _ in range(ROUNDS):
            begin = time.perf_counter()
            row = sample.agg(F.count("*"), F.count_if(F.expr(condition))).first()
            passed = time.perf_counter() - begin
            best = passed if best is None else min(best, passed)
        return best, row[0], row[1]

    # the same scan and job without a rule
    idle = seconds("length(text) + size(words) + n_words + word_chars + n_symbols + n_lines + n_dup_lines + n_repeat_words < 0")[0]
    out = []
    for rule in rules:
        spent, rows, rejected = seconds(rule.rejects)
        out.append(Estimate(rule, max(spent - idle, LEAST_COST), rejected / max(rows, 1)))
    return out


def ordered(sample: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """Rules by rejection per cost, each step on what the rules before it leave.

    The outcomes of all rules are counted by combination, so the driver gets a
    row per combination that occurs in the sample, not per document.
    """
    cost = {e.rule.name: e.seconds for e in estimates(sample, rules)}
    outcome = [F.coalesce(F.expr(r.rejects), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
    table = sample.select(*outcome).groupBy(*[f"r{i}" for i in range(len(rules))]).count().collect()
    left = [(tuple(row)[:-1], row["count"]) for row in table]
    order, open_ = [], list(range(len(rules)))
    while open_:
        gain = {i: sum(n for hits, n in left if hits[i]) / cost[rules[i].name] for i in open_}
        # a rule that rejects nothing more comes last, the cheapest of them first
        best = max(open_, key=lambda i: (gain[i], -cost[rules[i].name], -i))
        order.append(rules[best])
        open_.remove(best)
        left = [(hits, n) for hits, n in left if not hits[best]]
    return order


def cascade(rows: DataFrame, order: Sequence[Rule]) -> DataFrame:
    """Add rejected_by: the first rule in ``order`` that rejects a measured row, null if none does."""
    steps = F
    for rule in order:
        steps = steps.when(F.expr(rule.rejects), rule.name)
    return rows.withColumn("rejected_by", steps.otherwise(F.lit(None).cast("string")) if order else F.lit(None).cast("string"))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the measures, rejected_by and kept of every row of ``docs``.

    Reads ``docs`` twice, once for the sample; the rules cost many times what
    the second scan does.
    """
    total = docs.count()
    some = docs.select("doc_id", "text").sample(fraction=min(1.0, sample / max(total, 1)), seed=1)
    order = ordered(kept(measured(some), "sample"), rules) if total else list(rules)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    return cascade(measured(docs), order).select(*names, "rejected_by", F.col("rejected_by").isNull().alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """Base measures of every document, whether the two base rules reject it, and the verdict of all rules."""
    failed = F.expr(" OR ".join(f"({r.rejects})" for r in BASE_RULES))
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept"
    )


