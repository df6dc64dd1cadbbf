"""Exact nearest rows by distributed histogram selection.

Scores are integer inner products. Every query row meets every other row in
blocks, one matrix product for a block of queries and a block of rows. First
each block pair tells, per query, how many scores fall into each bin of a coarse
histogram; only bins down to the block's own k-th score are told, which is all
that the global k-th score can depend on. The counts are added up over all
blocks, the bin that holds the k-th score of each query is cut into finer bins,
and so on until a bin is a single score. A last pass keeps the scores that reach
it; of scores equal to it a block passes on its k smallest ids, which no tie
break can need more of.

What moves is counts per query and block, never scores. Blocks hold
``ROWS`` rows and ``QUERIES`` queries, so a task's memory does not grow.

Rows: a vector that is null, empty or holds null or non-finite components takes
no part, nor does a row without id. Shorter vectors count as filled up with
zeros. Rows that share an id are candidates each for themselves, but never for
a query of that id; a query id that occurs several times is answered once, by
its smallest vector. With no query or no other row there is no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept

ROWS = 8192
QUERIES = 1024
STEP = 8  # a bin is cut into 2^STEP finer ones

LEAST = np.iinfo(np.int64).min


def _pack(columns: list[str]):
    """One row of bytes for many rows: ids, vectors and further integer columns."""

    def pack(batch) -> dict:
        width = max((len(v) for v in batch.column("v")), default=0)
        matrix = np.zeros((batch.num_rows, width), dtype=np.int64)
        ids = batch.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        vectors = batch.column("v").to_pylist()
        for i, at in enumerate(order.tolist()):
            matrix[i, : len(vectors[at])] = vectors[at]
        out = {"ids": ids[order].tobytes(), "vectors": matrix.tobytes(), "width": width}
        return out | {c: batch.column(c).to_numpy()[order].tobytes() for c in columns}

    return pack


def _candidate_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield pa.RecordBatch.from_pylist([_pack([])(batch.slice(low, ROWS))], schema=_CANDIDATES)


def _query_block(table: pa.Table) -> pa.Table:
    packed = _pack(["low"])(table.combine_chunks())
    return pa.Table.from_pylist([packed | {"q": table.column("q")[0].as_py()}], schema=_QUERIES)


_CANDIDATES = pa.schema([("ids", pa.binary()), ("vectors", pa.binary()), ("width", pa.int32())])
_QUERIES = pa.schema([("q", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("width", pa.int32()), ("low", pa.binary())])


def _matrix(body: bytes, width: int, total: int) -> np.ndarray:
    if not width:
        return np.zeros((0, total), dtype=np.int64)
    own = np.frombuffer(body, dtype=np.int64).reshape(-1, width)
    return own if width == total else np.pad(own, ((0, 0), (0, total - width)))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products; in doubles where those are exact, else in 64-bit integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _scored(batch: pa.RecordBatch):
    """Query ids, candidate ids, scores and the bin found so far of each block pair; rows of the query's id score LEAST."""
    for i in range(batch.num_rows):
        row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
        total = max(row["q_width"], row["width"])
        scores = _scores(_matrix(row["q_vectors"], row["q_width"], total), _matrix(row["vectors"], row["width"], total))
        q_ids, c_ids = (np.frombuffer(row[c], dtype=np.int64) for c in ("q_ids", "ids"))
        scores[q_ids[:, None] == c_ids] = LEAST
        yield q_ids, c_ids, scores, np.frombuffer(row["low"], dtype=np.int64)


def _histogram(k: int, shift: int, before: int | None):
    """Counts per query and bin of width 2^shift, down to the block's own k-th score.

    After the first round only scores in the bin found so far, of width 2^before, count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, c_ids, scores, low in _scored(batch):
                if before is not None:
                    scores[(scores >> before) != low[:, None]] = LEAST
                floor = np.full(len(q_ids), LEAST)
                if len(c_ids) > k:
                    floor = np.partition(scores, len(c_ids) - k, axis=1)[:, len(c_ids) - k]
                query, column = np.nonzero((scores >= floor[:, None]) & (scores != LEAST))
                found = np.stack([query, scores[query, column] >> shift])
                values, n = np.unique(found, axis=1, return_counts=True)
                yield pa.record_batch({
                    "query_id": pa.array(q_ids[values[0]]), "bin": pa.array(values[1]), "n": pa.array(n.astype(np.int64)),
                })

    return run


def _reaching(k: int):
    """Scores above each query's k-th, and of those equal to it the k smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, c_ids, scores, low in _scored(batch):
                equal = scores == low[:, None]
                equal &= np.cumsum(equal, axis=1) <= k  # candidates of a block are in the order of their ids
                query, column = np.nonzero((scores > low[:, None]) | equal)
                yield pa.record_batch({
                    "query_id": pa.array(q_ids[query]), "vec_id": pa.array(c_ids[column]), "score": pa.array(scores[query, column]),
                })

    return run


def quantised(rows: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v) of the rows that take part, v the components floor(scale * x)."""
    finite = F.forall("x", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    return (
        rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
        .where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & finite)
        .select("vec_id", F.transform("x", lambda y: F.floor(y * scale)).alias("v"))
    )


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest inner products of each query.

    ``rows`` and ``queries`` have vec_id and v (array<long>); ties go to the smaller vec_id.
    Vectors whose square passes 64 bits are an error, as their scores would.
    """
    rows = kept(rows, "vectors")
    asked = kept(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "asked")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    norm = rows.union(asked).agg(F.max(square)).first()[0] or 0.0
    if norm >= 2.0**63:
        raise ValueError("inner products of these vectors may pass 64 bits")
    blocks = max(-(-asked.count() // QUERIES), 1)
    candidates = kept(rows.mapInArrow(_candidate_blocks, "ids binary, vectors binary, width int"), "blocks")
    # every block of rows is sent to every block of queries
    candidates = candidates.withColumn("q", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    state = asked.select("vec_id", "v", F.lit(0).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))

    def against(state: DataFrame) -> DataFrame:
        packed = (
            state.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).select("q", "vec_id", "v", "low")
            .groupBy("q").applyInArrow(_query_block, "q long, ids binary, vectors binary, width int, low binary")
        )
        packed = kept(packed, "queries").select(
            "q", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("width").alias("q_width"), "low"
        )
        return candidates.join(packed, "q").drop("q")

    # bins of the first round hold 2^shift scores; the largest score is at most the largest square
    shift, before = max(int(np.ceil(np.log2(norm + 2))) - STEP, 0), None
    while True:
        bins = against(state).mapInArrow(_histogram(k, shift, before), "query_id long, bin long, n long")
        bins = bins.groupBy(F.col("query_id").alias("vec_id"), "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("vec_id").orderBy(F.col("bin").desc())
        reached = bins.withColumn("seen", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0))).join(
            state.select("vec_id", "need"), "vec_id"
        )
        # the bin where the count reaches what is needed, or the lowest one
        low = reached.groupBy("vec_id").agg(
            F.coalesce(F.max(F.when(F.col("seen") >= F.col("need"), F.col("bin"))), F.min("bin")).alias("low")
        )
        last = reached.join(low.withColumnRenamed("low", "bin"), ["vec_id", "bin"]).select(
            "vec_id", F.col("bin").alias("low"), (F.col("need") - F.col("seen") + F.col("n")).alias("need")
        )
        state = kept(last.join(asked, "vec_id").select("vec_id", "v", "low", "need"), "state")
        if shift == 0:
            break
        shift, before = max(shift - STEP, 0), shift
    found = against(state).mapInArrow(_reaching(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
