"""Strict checks on JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_bad"}


def alone(text: Column) -> Column:
    """True when no text follows the first JSON value.

    The parser accepts such text. A value that is still one element when put
    into an array and one field when put into an object cannot have any.
    """
    return (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1) & (
        F.size(F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}")))) == 1
    )


def parse(text: Column, fields: str) -> Column:
    """Text as a struct of ``fields``, null unless it is one whole JSON object."""
    row = F.from_json(text, f"{fields}, _bad string", STRICT)
    return F.when(alone(text) & F.json_object_keys(text).isNotNull() & row["_bad"].isNull(), row)


def parse_array(text: Column, element: str) -> Column:
    """Text as an array of ``element``, null unless it is one whole JSON array."""
    row = parse(F.concat(F.lit('{"v":'), text, F.lit("}")), f"v array<{element}>")
    return F.when(F.json_array_length(text).isNotNull(), row["v"])
