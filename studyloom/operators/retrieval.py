"""Nearest chunks for questions, and the prompts made of them.

``chunks``: id, vector, and for the context text and source. ``queries``:
query_id, vector.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import first_n

NEIGHBOURS = 5
# A block pair needs one matrix of TILE x BLOCK_CHUNKS doubles, 40 MiB.
BLOCK_QUERIES = 20_000
BLOCK_CHUNKS = 20_000
TILE = 256
# Candidates that are measured at once, and how many vectors share a minimum.
MEASURED = 50_000
STRIDE = 16


def _hits(queries: DataFrame, chunks: DataFrame) -> str:
    types = [rows.schema[name].dataType.simpleString() for rows, name in ((queries, "query_id"), (chunks, "id"))]
    return "query_id {}, id {}, distance double".format(*types)


def _limits(rough: np.ndarray, take: int) -> np.ndarray:
    """For each row a value that ``take`` of its numbers do not pass, nearly the smallest such value.

    The minima of groups of numbers stand for the numbers where there are enough of them.
    """
    groups = rough.shape[1] // STRIDE
    if groups >= 4 * take:
        rough = rough[:, : groups * STRIDE].reshape(len(rough), STRIDE, groups).min(axis=1)
    return np.partition(rough, take - 1, axis=1)[:, take - 1]


def _best(points: np.ndarray, vectors: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of a block of vectors for each point: numbers of points and vectors, exact squared distances.

    Matrix products find the candidates; distances are then taken from the
    differences, so that equal vectors tie exactly and ties go to the smaller
    ``place``.
    """
    take = min(k, len(vectors))
    rough = points @ vectors.T
    rough *= -2.0
    rough += (points**2).sum(1)[:, None]
    rough += (vectors**2).sum(1)[None, :]
    slack = 1e-9 * (1.0 + max(rough.max(), -rough.min()))
    near = rough <= (_limits(rough, take) + slack)[:, None]
    # a row may have all vectors as candidates, so only so many rows are measured at once
    ends = np.cumsum(np.count_nonzero(near, axis=1))
    found, low = [], 0
    while low < len(points):
        high = max(int(np.searchsorted(ends, (ends[low - 1] if low else 0) + MEASURED, side="right")), low + 1)
        row, at = np.nonzero(near[low:high])
        exact = ((vectors[at] - points[row + low]) ** 2).sum(1)
        order = np.lexsort((place[at], exact, row))
        row, at, exact = row[order], at[order], exact[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < take
        found.append((row[first] + low, at[first], exact[first]))
        low = high
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _points(block: pa.Scalar, name: str) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of a block, a list of (id, vector)."""
    rows = block.values
    vectors = rows.field("vector").combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows.field("vector")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return rows.field(name), flat.reshape(len(rows), -1)


def _nearest(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, asked in zip(batch.column("found"), batch.column("asked")):
                ids, vectors = _points(found, "id")
                query_ids, points = _points(asked, "query_id")
                place = np.empty(len(ids), dtype=np.int64)
                place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
                for low in range(0, len(points), TILE):
                    row, at, distance = _best(points[low : low + TILE], vectors, place, k)
                    yield pa.record_batch({
                        "query_id": query_ids.take(pa.array(row + low)), "id": ids.take(pa.array(at)), "distance": pa.array(distance),
                    })

    return search


def knn(queries: DataFrame, chunks: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The k nearest chunks of every query by squared distance, exactly.

    One plan for any number of queries: chunks and queries are gathered into
    blocks of bounded size, every pair of blocks is one row that any task can
    take, and k rows per query come back from it. Rows without a vector take no
    part. Counts both sides (runs jobs) to fix the number of blocks.
    """
    schema = _hits(queries, chunks)
    chunks = chunks.where("vector IS NOT NULL").select("id", "vector")
    queries = queries.where("vector IS NOT NULL").select("query_id", "vector")
    shares = max(1, -(-chunks.count() // BLOCK_CHUNKS))
    groups = max(1, -(-queries.count() // BLOCK_QUERIES))
    found = chunks.groupBy(F.pmod(F.xxhash64("id"), F.lit(shares)).alias("share")).agg(
        F.collect_list(F.struct("id", "vector")).alias("found")
    )
    asked = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("part")).agg(
        F.collect_list(F.struct("query_id", "vector")).alias("asked")
    )
    found = found.select("found", "share", F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("part"))
    asked = asked.select("asked", "part", F.explode(F.expr(f"sequence(0L, {shares - 1}L)")).alias("share"))
    pairs = found.join(asked, ["share", "part"]).select("found", "asked")
    return first_n(pairs.mapInArrow(_nearest(k), schema), ["query_id"], [F.col("distance"), F.col("id")], k, "rank")


# The inverted file is fitted on about this many vectors, drawn at random, in so many rounds.
SAMPLE = 20_000
ROUNDS = 10
MOST_CELLS = 4096
# Recall that the number of probed cells is chosen for, on so many of the queries.
RECALL = 0.95
TRIED = 256


@dataclass(frozen=True)
class Cells:
    """Centres of an inverted file, and the sample they are fitted on."""

    centres: np.ndarray
    points: np.ndarray


def fit_cells(chunks: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Cells:
    """Cells of an inverted file (k-means on a bounded sample).

    By default as many as the square root of the number of vectors, ``MOST_CELLS`` at most.
    """
    vectors = chunks.where("vector IS NOT NULL").select("id", "vector")
    count = vectors.count()
    if not count:
        return Cells(np.zeros((0, 0)), np.zeros((0, 0)))
    drawn = vectors.sample(fraction=min(1.0, sample / count), seed=1).orderBy(F.xxhash64("id"), "id").limit(2 * sample)
    points = np.array([r["vector"] for r in drawn.select("vector").collect()], dtype=np.float64)
    if not len(points):
        points = np.array([vectors.first()["vector"]], dtype=np.float64)
    cells = min(cells or int(count**0.5) or 1, MOST_CELLS, len(points))
    rng = np.random.default_rng(1)
    centres = points[rng.choice(len(points), cells, replace=False)]
    for _ in range(ROUNDS):
        nearest = _nearest_cells(points, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        n = np.bincount(nearest, minlength=cells)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return Cells(centres, points)


def enough_probes(queries: DataFrame, cells: Cells, k: int = NEIGHBOURS, recall: float = RECALL) -> int:
    """Cells to probe so that some of the queries find that share of their k nearest in the sample."""
    drawn = queries.where("vector IS NOT NULL").orderBy(F.xxhash64("query_id"), "query_id").limit(TRIED)
    asked = np.array([r["vector"] for r in drawn.select("vector").collect()], dtype=np.float64)
    if not len(asked):
        return 1
    home = _nearest_cells(cells.points, cells.centres, 1)[:, 0]
    norms = (cells.points**2).sum(1)
    ranks = []
    for point, order in zip(asked, _nearest_cells(asked, cells.centres, len(cells.centres))):
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        ranks.append(place[home[np.argsort(norms - 2.0 * cells.points @ point, kind="stable")[:k]]])
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[min(int(np.ceil(recall * len(ranks))), len(ranks)) - 1]) + 1


def _nearest_cells(points: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centres of each point, a bounded number of points at a time."""
    norms, out = (centres**2).sum(1), []
    for low in range(0, len(points), 4096):
        distance = norms[None, :] - 2.0 * points[low : low + 4096] @ centres.T
        out.append(np.argsort(distance, axis=1, kind="stable")[:, :n])
    return np.concatenate(out)


def _with_cells(rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector")
            points = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            near = _nearest_cells(points, shared.value, n)
            cells = pa.array([row.tolist() for row in near], pa.list_(pa.int32()))
            yield pa.record_batch([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    fields = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, cells array<int>")


def assign_cells(chunks: DataFrame, cells: Cells) -> DataFrame:
    """Every chunk (id, vector) with the cell it belongs to."""
    rows = chunks.where("vector IS NOT NULL").select("id", "vector")
    if not len(cells.centres):
        return rows.withColumn("cell", F.lit(0))
    return _with_cells(rows, cells.centres, 1).select("id", "vector", F.col("cells")[0].alias("cell"))


def knn_probed(queries: DataFrame, indexed: DataFrame, cells: Cells, k: int = NEIGHBOURS, probes: int | None = None) -> DataFrame:
    """The k nearest chunks of every query among those of its nearest cells.

    ``indexed``: id, vector, cell. By default as many cells are probed as
    ``enough_probes`` finds; with all cells the result is exact. A cell is cut
    into blocks of bounded size, so one that holds most chunks is no bottleneck.
    """
    schema = _hits(queries, indexed)
    queries = queries.where("vector IS NOT NULL").select("query_id", "vector")
    centres = cells.centres
    if not len(centres):
        return knn(queries, indexed, k)
    probes = min(probes or enough_probes(queries, cells, k), len(centres))
    shares = indexed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_CHUNKS).cast("int").alias("shares"))
    found = (
        indexed.join(shares, "cell")
        .groupBy("cell", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"))
        .agg(F.collect_list(F.struct("id", "vector")).alias("found"))
    )
    asked = _with_cells(queries, centres, probes).select("query_id", "vector", F.explode("cells").alias("cell"))
    parts = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("parts"))
    asked = (
        asked.join(parts, "cell")
        .groupBy("cell", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"))
        .agg(F.collect_list(F.struct("query_id", "vector")).alias("asked"))
    )
    asked = asked.join(shares, "cell").select("cell", "asked", F.explode(F.expr("sequence(0, shares - 1)")).alias("share"))
    pairs = found.join(asked, ["cell", "share"]).select("found", "asked")
    return first_n(pairs.mapInArrow(_nearest(k), schema), ["query_id"], [F.col("distance"), F.col("id")], k, "rank")


def context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per query: chunk texts in rank order, parted by blank lines, and their sources.

    A query has k hits at most, so its list is bounded.
    """
    texts = chunks.select("id", "text", "source")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "text", "source")))
    return (
        hits.join(texts, "id")
        .groupBy("query_id")
        .agg(ordered.alias("hits"))
        .select(
            "query_id",
            F.array_join(F.transform("hits", lambda h: h["text"]), "\n\n").alias("context"),
            F.transform("hits", lambda h: F.coalesce(h["source"], F.lit("Unknown"))).alias("sources"),
        )
    )


def prompt(template: str, **values: Column) -> Column:
    """A text with its {name} places filled from columns."""
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(values[field].cast("string"))
    return F.concat(*parts)


def topic_in_module(topic: Column, module_name: Column) -> Column:
    """Topic with the module it is asked in, where there is one."""
    # Fixed value: the French wording of the suffix.
    suffixed = F.concat(topic, F.lit(" (dans le contexte de "), module_name, F.lit(")"))
    return F.when(F.coalesce(module_name, F.lit("")) != "", suffixed).otherwise(topic)
