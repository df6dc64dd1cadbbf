"""Running XP, streak and level per user, as activities arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import activity as batch

ACCOUNTS = batch.ACCOUNTS


def live_ledger(rows: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ledger rows of a batch of activities, where its users stand after it, and what both are made of.

    A step of a stream (``sinks.write_steps``). ``accounts`` (``ACCOUNTS``)
    holds one row per user: XP, streak and last active day. Within a batch
    activities count in order of time; those of an earlier day than the user's
    last one leave the streak as it is. As in the batch ledger, a user's rows
    are met by (user, hour) only, so no task holds a user's whole log.
    """
    slices = batch.time_slices(rows, accounts=accounts).persist()
    ledger = batch.xp_ledger(rows, accounts, slices).select(
        "user_id", "activity_id", "streak", "streak_before", "xp_gained", "total_xp", "old_level", "new_level", "level_up"
    )
    return ledger, batch.accounts_after(slices, accounts), slices


def result_events(results: DataFrame) -> DataFrame:
    """Final results of rooms as activities of type multiplayer_quiz; ``ended_at`` is their time."""
    return results.select(
        "*", F.xxhash64("room_id", "user_id").alias("activity_id"), F.col("ended_at").alias("ts"),
        F.lit("multiplayer_quiz").alias("activity_type"), F.lit(None).cast("string").alias("difficulty"),
    )


def live_awards(rows: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Final results of a batch of ended rooms with the XP and level they lead to; a step like ``live_ledger``."""
    ledger, after, slices = live_ledger(rows.withColumn("score", F.lit(None).cast("double")), accounts)
    reached = ledger.select("user_id", "activity_id", "xp_gained", "total_xp", "new_level")
    results = rows.drop("ts", "activity_type", "difficulty").join(reached, ["user_id", "activity_id"]).drop("activity_id")
    return results, after, slices
