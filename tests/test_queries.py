"""Every named query against its checking SQL, on the whole tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()
# Queries that find nothing in the smallest tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    rows = entry.queries()[name](spark, FOLDER)
    if name in ORACLES:
        problem = difference(rows, ORACLES[name], FOLDER)
        assert problem == "" or (problem == "no rows" and name in MAY_BE_EMPTY), problem
    else:
        assert rows.count() > 0


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0
    assert "level" in rows.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
