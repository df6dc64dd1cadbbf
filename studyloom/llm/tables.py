"""Tables in the shared folder, and connected components on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.session import shared_folder


#: Bits of a sieve for each of its keys, within bounds; the upper one is 16 MB.
SIEVE_BITS = 16
LEAST_BITS, MOST_BITS = 15, 27


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the folder that all executors share and read it again.

    Cuts lineage, so a lost executor costs the running stage only, and gives
    joins a plain exchange on either side, which adaptive execution can split
    when a key is hot.
    """
    folder = shared_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def sieved(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be in ``keys`` (one column of that type, repeats allowed, read twice).

    Every row whose value is in ``keys`` stays, and one in 16 of the others: a
    bit of each key's hash goes out to all tasks, ``SIEVE_BITS`` bits a key and
    at most 2^``MOST_BITS`` in all. For use ahead of a join with few of the rows
    of ``df``, which then moves those alone; with more keys than bits it moves
    more, and the result is the same.
    """
    bits = 1 << min(max((SIEVE_BITS * keys.count()).bit_length(), LEAST_BITS), MOST_BITS)

    def place(name: str) -> str:
        return f"(pmod(xxhash64(`{name}`), {bits}L) + 1)"

    at = place(keys.columns[0])
    packs = kept(
        keys.groupBy(F.expr(f"bitmap_bucket_number({at})").alias("sieve_pack")).agg(
            F.expr(f"bitmap_construct_agg(bitmap_bit_position({at}))").alias("sieve_bits")
        ).coalesce(8),  # of bounded size: few tasks and files
        "sieve",
    )
    at = place(column)
    byte = f"conv(hex(substring(sieve_bits, int(bitmap_bit_position({at}) div 8) + 1, 1)), 16, 10)"
    return (
        df.join(F.broadcast(packs), F.expr(f"bitmap_bucket_number({at}) = sieve_pack"))
        .where(f"getbit(int({byte}), int(bitmap_bit_position({at}) % 8)) = 1")
        .select([f"`{c}`" for c in df.columns])
    )


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge; the component is its smallest id.

    ``edges`` has the columns a and b, in any direction, repeats allowed. Each
    round every vertex and its parent hook onto the smallest grandparent among
    the neighbours, then paths are halved, so rounds grow with the logarithm
    of the diameter. A round is joins and partial minima only: no list of
    neighbours is ever gathered, and a hub is split like any hot join key.
    """
    both = kept(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct(),
        "edges",
    )
    parents = kept(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("f")), "parents")
    while True:
        up = parents.select(F.col("id").alias("f"), F.col("f").alias("g"))
        grand = kept(parents.join(up, "f").select("id", "f", "g"), "grand")
        near = (
            both.join(grand.select(F.col("id").alias("b"), "g"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("g").alias("m"))
        )
        # one row per vertex: hook the vertex and its parent
        hooks = near.join(grand, "id").select(
            F.explode(
                F.array(
                    F.struct(F.col("id"), F.least("f", "g", "m").alias("f")),
                    F.struct(F.col("f").alias("id"), F.col("m").alias("f")),
                )
            ).alias("h")
        )
        new = kept(hooks.select("h.*").groupBy("id").agg(F.min("f").alias("f")), "parents")
        changed = new.join(parents.withColumnRenamed("f", "old"), "id").where("f <> old").limit(1).count()
        parents = new
        if not changed:
            break
    return parents.select("id", F.col("f").alias("component"))
