"""Reading and checking entity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHOICES, ENTITIES


def read_entity(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One entity table with its declared schema; absent columns read as null."""
    return spark.read.schema(ENTITIES[name]).parquet(f"{folder.rstrip('/')}/{name}")


def invalid_choices(rows: DataFrame, name: str) -> DataFrame:
    """Rows of entity ``name`` whose choice columns hold a value outside the allowed ones."""
    bad = F.lit(False)
    for (entity, column), allowed in CHOICES.items():
        if entity == name:
            bad = bad | F.coalesce(~F.col(column).isin(allowed), F.lit(False))
    return rows.where(bad)
