import sys
import zlib

import pytest
from pyspark.sql import types as T

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text, lower=False):
    body = (text or "").encode()
    return (body.translate(LOWER) if lower else body).split()


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


# columns whose names the operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t int, id long, row long, part int, band int, `a.b` string"


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents with extra columns from (doc_id, text, lang) rows."""

    def run(rows):
        full = [
            (i, x, lang, "s", None if x is None else len(x), 7, 7, 7, 7, 7, "z") for i, x, lang in rows
        ]
        return spark.createDataFrame(full, SCHEMA)

    return run


def base_text(seed, n):
    """A text of n made-up words, the same for the same seed."""
    state, out = seed * 2654435761 % 2**32 or 1, []
    for _ in range(n):
        state = (1103515245 * state + 12345) % 2**31
        out.append("".join("abcdefghij"[state // 10**k % 10] for k in range(3, 3 + 2 + state % 4)))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and white texts, ties, repeated rows, a very long text, near and exact copies."""
    a, b, c = base_text(1, 200), base_text(2, 120), base_text(3, 90)
    rows = [
        (0, None, "en"), (1, "", "en"), (2, " \t\n\x0b ", None), (3, "one two", "en"), (4, "one two", "de"), (5, "ONE\ntwo", "en"),
        (10, a, "en"), (11, a, "en"), (11, a, "en"), (12, a + " tail", "en"), (13, b + " " + c, "de"), (14, c, "de"), (15, c.upper(), "fr"),
        (16, a.replace(" ", "  ", 20) + " more words here", "en"), (17, " ".join(["same"] * 400), "en"), (18, " ".join(["same"] * 300) + " end", "en"),
        (None, a, "en"), (None, None, None), (20, base_text(9, 40_000), "fr"), (21, "12 345 -- !!", "en"), (22, "Éa ñandú ça x   日本語", "es"),
        (23, c + " " + base_text(30, 60) + " " + b, "de"), (24, "x" * 5000, "en"), (-5, b, "de"),
    ]
    return rows
