"""Compare a registered query with its checking SQL, ignoring row order."""

from __future__ import annotations

import collections
import datetime
import decimal
import math
import os

import duckdb
import numpy as np

from studyloom.plans.registry import TABLES

DATA = "/root/testdata/sf0.01"


def plain(value):
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, collections.Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def sql_rows(sql, folder=DATA):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = collections.Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    return sorted(names), rows


def difference(df, sql, folder=DATA):
    """Empty text when equal, else a short account of what differs."""
    names, mine = spark_rows(df)
    other_names, theirs = sql_rows(sql, folder)
    if names != other_names:
        return f"columns {names} vs {other_names}"
    if mine != theirs:
        extra, missing = mine - theirs, theirs - mine
        return (
            f"{names}: {sum(mine.values())} vs {sum(theirs.values())} rows; "
            f"only here {list(extra)[:3]}; only there {list(missing)[:3]}"
        )
    return "" if mine else "no rows"
