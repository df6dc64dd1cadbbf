"""Keep costly row expressions from being evaluated again and again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly before costly row expressions.

    Small rows that grow in a view come from few splits of a small file, one
    task each, however much there is to do for a row.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks)


def hold(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add (or replace) a column that is computed once per row.

    The optimizer copies the expression of a column into each later use and
    into filters pushed below it, which grows fast when steps build on each
    other. The output of a one-element explode is not copied.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(value)).alias(name))
