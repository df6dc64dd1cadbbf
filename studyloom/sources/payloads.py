"""Request bodies: JSON text to typed rows, with the rejected ones kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext
from ..functions.text import strip
from ..operators.staging import hold

# The answers given to rejected requests.
INVALID = "Invalid JSON format"
EMPTY = {"code": "Empty code", "message": "Empty message"}
STRIPPED = ["code"]
ANSWER_LIMIT_SECONDS = 60


def judge_payloads(bodies: DataFrame, fields: str, required: str | None = None) -> DataFrame:
    """Rows with a ``body`` column, with ``payload`` and the ``reason`` to reject it, null for none.

    ``required`` names a text field that must not be empty.
    """
    reason = F.when(F.col("payload").isNull(), INVALID)
    if required:
        value = F.coalesce(F.col("payload")[required], F.lit(""))
        if required in STRIPPED:
            value = strip(value)
        reason = reason.when(value == "", EMPTY.get(required, f"Empty {required}"))
    return hold(bodies, "payload", jsontext.parse(F.col("body"), fields)).withColumn("reason", reason)


def answer_time(payload: str = "payload") -> Column:
    """Response time of an answer message; without one the whole time is taken."""
    return F.coalesce(F.col(payload)["response_time"], F.lit(ANSWER_LIMIT_SECONDS).cast("double"))


def decode_payloads(bodies: DataFrame, fields: str, required: str) -> tuple[DataFrame, DataFrame]:
    """Split rows with a ``body`` column into (accepted, rejected).

    Accepted rows carry ``payload``, rejected ones ``reason``. ``required``
    names the text field that must not be empty.
    """
    judged = judge_payloads(bodies, fields, required)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").drop("payload")
