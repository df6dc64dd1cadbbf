"""All named queries."""

from __future__ import annotations

from . import activity, corpus, exercises, rooms, sessions, streams, texts  # noqa: F401  (importing registers the queries)
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
