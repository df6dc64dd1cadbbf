"""Running sums and positions that do not put a whole group into one task.

A window over a key sorts every row of that key in one task. Where a key may
hold a large part of all rows, the rows are cut into slices by a coarse prefix
of the order: a window runs inside each slice, a second one over the slice
totals, and the two are added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    slices: Sequence[tuple[str, bool]],
    order: Sequence[Column],
    sums: Mapping[str, Column],
) -> DataFrame:
    """Add running sums per ``keys``.

    ``slices`` lists (column, descending) pairs that form a prefix of the full
    order; ``order`` is the complete order inside a slice. ``sums`` maps output
    names to non-null values. Rows with equal ``order`` get an arbitrary but
    distinct place, so the caller ends the order with an id.
    """
    cut = [*keys, *(name for name, _ in slices)]
    inside = Window.partitionBy(*cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select(
        "*", *[F.sum(value).over(inside).alias(f"__in_{name}") for name, value in sums.items()]
    )
    totals = df.groupBy(*cut).agg(*[F.sum(v).alias(f"__all_{n}") for n, v in sums.items()])
    over_slices = (
        Window.partitionBy(*keys)
        .orderBy(*[F.col(n).desc() if desc else F.col(n).asc() for n, desc in slices])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = totals.select(
        *cut,
        *[
            F.coalesce(F.sum(f"__all_{n}").over(over_slices), F.lit(0)).alias(f"__before_{n}")
            for n in sums
        ],
    )
    return local.join(before, cut).select(
        *df.columns,
        *[(F.col(f"__in_{n}") + F.col(f"__before_{n}")).alias(n) for n in sums],
    )


def positions(
    df: DataFrame,
    keys: Sequence[str],
    slices: Sequence[tuple[str, bool]],
    order: Sequence[Column],
    name: str = "position",
) -> DataFrame:
    """Add the 1-based place of every row inside its key."""
    return running_sums(df, keys, slices, order, {name: F.lit(1).cast("long")})


#: Rows that a key is sorted in at once; larger keys are cut into ``BANDS`` quantiles.
BAND = 4096
BANDS = 256


def banded_positions(df: DataFrame, keys: Sequence[str], rough: Column, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Add the 1-based place of every row inside its key, by bands of about equal size.

    ``rough`` is a number that never falls along ``order``. Only keys with more
    than ``BAND`` rows are cut, at the quantiles of ``rough``, so their number
    of bands is bounded and so is the window over them. Reads ``df`` several
    times, once to count (a job); write it first where it is expensive.
    """
    rows = df.withColumn("__rough", rough)
    large = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > BAND).select(*keys)
    if not large.limit(1).count():
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    shares = [i / BANDS for i in range(1, BANDS)]
    cuts = rows.join(large, list(keys), "left_semi").groupBy(*keys).agg(
        F.percentile_approx("__rough", shares, 64 * BANDS).alias("__cuts")
    )
    below = F.size(F.filter("__cuts", lambda c: c < F.col("__rough")))
    banded = rows.join(cuts, list(keys), "left").withColumn("__band", F.when(F.col("__cuts").isNull(), 0).otherwise(below))
    banded = banded.drop("__cuts", "__rough")
    return positions(banded, keys, [("__band", False)], order, name).drop("__band")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "position") -> DataFrame:
    """The first ``n`` rows per key, numbered from 1.

    The filter on ``row_number`` is pushed below the shuffle by the optimizer
    (window group limit), so each task sends on at most ``n`` rows per key.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, place).where(F.col(name) <= n)
