"""Token ids in binary files: frequency ranks in byte-aligned variable length.

A file is a series of segments of about ``SEGMENT_TOKENS`` ids, whole documents
in ascending doc_id order. The most frequent id of the corpus has rank 0, and so
on (ties to the smaller id); the table of ranks, bounded by the vocabulary, lies
beside the segments. Texts are encoded once: the ids of a segment are first
written as they are, in two bytes if they fit, with their counts; the counts are
added up, and then the segments are written with the ranks of the corpus. A rank takes one to four bytes; how many, less one, is kept apart in two bits of the control bytes
(four ranks to a byte, the first in the lowest bits). Reading looks the lengths
of four ranks up by their control byte and gathers all ranks at once.

The containers are Parquet (``segments``, one row for each, and ``ranks``), written by Spark's own writer,
so any store that Spark reaches will do. Texts are dealt to tasks by ranges of
doc_id and encoded there; a task holds one segment at a time. The number of the
range and that of the segment in it give the order.

Null text is empty and gives the end id alone. Rows without id come first. Rows
with the same id follow one another, ordered by their text. An empty table
gives no segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studyloom.session import shared_folder

from .bpe import crc32, encoded
from .tables import kept

END = 0
SEGMENT_TOKENS = 1 << 20

FORMAT = "part int, segment int, doc_ids array<long>, sizes array<long>, control binary, data binary"
RANKS = "id int, rank int"
_DRAFT = "part int, segment int, doc_ids array<long>, sizes array<long>, ids binary, present binary, counts binary"
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def to_bytes(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of some ranks."""
    ranks = ranks.astype("<u4", copy=False)
    longest = max((int(ranks.max(initial=0)).bit_length() + 7) // 8, 1)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    code = padded[: len(ranks)]
    for k in range(1, longest):
        code += ranks >= 1 << 8 * k
    four = padded.view("<u4")  # two bits of each byte move into the lowest
    control = (four | four >> 6 | four >> 12 | four >> 18).astype(np.uint8)
    ends = np.cumsum(code, dtype=np.int64) + np.arange(1, len(code) + 1)
    at = ends - code - 1
    data = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    data[at] = ranks.astype(np.uint8)
    for k in range(1, longest):
        more = np.flatnonzero(code >= k)
        data[at[more] + k] = (ranks[more] >> 8 * k).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def from_bytes(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The first ``count`` ranks of a control and a data stream."""
    size = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:count]
    at = np.cumsum(size, dtype=np.int64) - size
    body = np.frombuffer(data, dtype=np.uint8)
    ranks = body[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=0))):
        more = np.flatnonzero(size > k)
        ranks[more] |= body[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _draft(part: int, number: int, doc_ids: list, texts: list[bytes]) -> pa.RecordBatch:
    """A segment as plain ids, which ids it holds and how often."""
    ids = np.frombuffer(b"".join(texts), dtype="<u4")
    counts = np.bincount(ids)
    present = np.flatnonzero(counts)
    return pa.record_batch({
        "part": pa.array([part], pa.int32()),
        "segment": pa.array([number], pa.int32()),
        "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
        "sizes": pa.array([[len(x) // 4 for x in texts]], pa.list_(pa.int64())),
        "ids": pa.array([ids.astype("<u2" if len(counts) <= 1 << 16 else "<u4").tobytes()], pa.binary()),
        "present": pa.array([present.astype("<u4").tobytes()], pa.binary()),
        "counts": pa.array([counts[present].astype("<i8").tobytes()], pa.binary()),
    })


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of ids, added up over the segments of a task."""
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for present, counts in zip(batch.column("present").to_pylist(), batch.column("counts").to_pylist()):
            ids = np.frombuffer(present, dtype="<u4")
            if len(ids) and ids.max() >= len(total):
                total = np.pad(total, (0, int(ids.max()) + 1 - len(total)))
            total[ids] += np.frombuffer(counts, dtype="<i8")
    ids = np.flatnonzero(total)
    yield pa.record_batch({"id": pa.array(ids.astype(np.int32)), "n": pa.array(total[ids])})


def _ranked(shared):
    """Segments with the ranks of the corpus in place of plain ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        names = [f.split()[0] for f in FORMAT.split(", ")]
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                ids, count = one.column("ids")[0].as_py(), int(np.sum(one.column("sizes")[0].as_py()))
                new = dict(zip(("control", "data"), to_bytes(rank[np.frombuffer(ids, dtype=f"<u{len(ids) // count}")])))
                yield pa.record_batch([pa.array([new[c]], pa.binary()) if c in new else one.column(c) for c in names], names=names)

    return run


def _segments(path: str, end: int):
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, texts, held, number, part = [], [], 0, 0, -1
        for batch in batches:
            for piece, own in encoded(batch, path):
                for doc, p, ids in zip(piece.column("doc_id").to_pylist(), piece.column("part").to_pylist(), own):
                    if texts and (p != part or held >= SEGMENT_TOKENS):
                        yield _draft(part, number, doc_ids, texts)
                        number = number + 1 if p == part else 0
                        doc_ids, texts, held = [], [], 0
                    part = p
                    doc_ids.append(doc)
                    texts.append(ids + tail)
                    held += len(ids) // 4 + 1
        if texts:
            yield _draft(part, number, doc_ids, texts)

    return run


def write(docs: DataFrame, path: str, folder: str, end: int = END) -> None:
    """Encode ``docs`` and write their files to ``folder``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id())
    ordered = ordered.sortWithinPartitions(F.col("part"), F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    drafts = kept(ordered.mapInArrow(_segments(path, end), _DRAFT), "drafts")
    counts = drafts.select("present", "counts").mapInArrow(_counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # as many rows as the vocabulary has ids, at most
    order = [r["id"] for r in counts.orderBy(F.col("n").desc(), "id").select("id").collect()]
    rank = np.zeros(max(order, default=0) + 1, dtype=np.uint32)
    rank[order] = np.arange(len(order))
    spark = docs.sparkSession
    spark.createDataFrame(list(zip(order, range(len(order)))), RANKS).coalesce(1).write.parquet(f"{folder}/ranks")
    drafts.drop("present", "counts").mapInArrow(_ranked(spark.sparkContext.broadcast(rank)), FORMAT).write.parquet(f"{folder}/segments")


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, np.ndarray]:
    """The segments of a folder, and the ids by rank."""
    ranks = spark.read.schema(RANKS).parquet(f"{folder}/ranks").collect()
    ranked = np.zeros(len(ranks), dtype=np.uint32)
    for r in ranks:
        ranked[r["rank"]] = r["id"]
    return spark.read.schema(FORMAT).parquet(f"{folder}/segments"), ranked


def segment_ids(ranked: np.ndarray, control: bytes, data: bytes, count: int) -> np.ndarray:
    return ranked[from_bytes(control, data, count)]


def _documents(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, segment, doc_ids, sizes, control, data = (batch.column(c)[row].as_py() for c in range(6))
                sizes = np.array(sizes, dtype=np.int64)
                ids = segment_ids(shared.value, control, data, int(sizes.sum()))
                ends = np.cumsum(sizes)
                body = memoryview(ids.astype("<u4", copy=False)).cast("B")
                yield pa.record_batch({
                    "part": pa.array([part] * len(sizes), pa.int32()),
                    "segment": pa.array([segment] * len(sizes), pa.int32()),
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "at": pa.array(ends - sizes),
                    "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array([crc32(body[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())], pa.int64()),
                })

    return run


def documents(segments: DataFrame, ranked: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of some files.

    Segments before a document are summed per range first, so the window over
    all ranges sees one row each.
    """
    total = segments.select(
        "part", "segment", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")
    )
    parts = total.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = total.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "part"
    ).select("part", "segment", (F.col("own") + F.col("base")).alias("first"))
    rows = segments.mapInArrow(
        _documents(segments.sparkSession.sparkContext.broadcast(ranked)), "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    return rows.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Write the files of ``docs`` to the shared folder and report what they hold."""
    folder = shared_folder(docs.sparkSession, "tokens")
    write(docs, path, folder, end)
    return documents(*read(docs.sparkSession, folder))
