"""Documents packed into sequences of a fixed number of tokens, best two fit.

Texts are encoded where they lie; only the lengths of pieces move. The pieces
are dealt evenly to groups of about ``GROUP``, each packed by one task: longest
first, always the longest piece that still fits; then the smallest piece of a
bin gives way to two waiting pieces if those fill its gap more tightly. A group
works on counts per length, so copies cost nothing extra, and it wastes no more
than its last bins.

Null text is empty and gives the end id alone. Rows without id are packed too.
Every input row is a document of its own, also where ids repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import crc32, encoded
from .tables import kept

SEQUENCE_TOKENS = 4096
END = 1
GROUP = 50_000

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, size: int, end: int):
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in encoded(batch, path):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(texts):
                    ids += tail
                    for p, low in enumerate(range(0, len(ids), 4 * size)):
                        body = ids[low : low + 4 * size]
                        row.append(i)
                        piece.append(p)
                        start.append(low // 4)
                        length.append(len(body) // 4)
                        crc.append(crc32(body))
                at = pa.array(row, pa.int32())
                yield pa.record_batch({
                    "doc_id": part.column("doc_id").take(at),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "row": part.column("row").take(at),
                })

    return run


class _Waiting:
    """Pieces that are not packed yet, as counts per length."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.count = np.bincount(lengths, minlength=size + 1)
        self.left = int(self.count.sum())
        self._refresh()

    def _refresh(self) -> None:
        there = np.where(self.count > 0, np.arange(len(self.count)), 0)
        self.floor = np.maximum.accumulate(there)  # longest waiting length up to each bound, 0 for none

    def longest(self, bound: int) -> int:
        return int(self.floor[bound]) if bound > 0 else 0

    def take(self, length: int) -> None:
        self.count[length] -= 1
        self.left -= 1
        if not self.count[length]:
            lower = self.floor[length - 1]
            # every bound that had this length as its best falls back to the next lower one
            stop = int(np.searchsorted(self.floor, length, side="right"))
            self.floor[length:stop] = lower

    def put(self, length: int) -> None:
        if not self.count[length]:
            stop = max(int(np.searchsorted(self.floor, length, side="right")), length)
            self.floor[length:stop] = length
        self.count[length] += 1
        self.left += 1

    def pair(self, bound: int) -> tuple[int, int]:
        """Two waiting lengths with the largest sum up to ``bound``, (0, 0) for none."""
        first = np.flatnonzero(self.count[: bound + 1])
        if not len(first):
            return 0, 0
        first = first[first > 0]
        second = self.floor[np.minimum(bound - first, first)]
        # the same length twice needs two pieces
        lonely = (second == first) & (self.count[first] < 2)
        second = np.where(lonely, self.floor[np.maximum(second - 1, 0)], second)
        total = np.where(second > 0, first + second, 0)
        if not len(total) or not total.max():
            return 0, 0
        i = int(total.argmax())
        return int(first[i]), int(second[i])


def best_two_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of lengths, each with a sum of ``size`` at most."""
    waiting = _Waiting(lengths, size)
    bins = []
    while waiting.left:
        own: list[int] = []
        gap = size
        while (best := waiting.longest(gap)):
            waiting.take(best)
            own.append(best)
            gap -= best
        if gap and len(own) > 1:
            smallest = own[-1]
            a, b = waiting.pair(gap + smallest)
            if a + b > smallest:
                own.pop()
                waiting.take(a)
                waiting.take(b)
                waiting.put(smallest)
                own += [a, b]
        bins.append(own)
    return bins


def _packed(size: int):
    """Number the bins of a group and place its pieces in them, equal lengths by id."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_numpy()
        first = np.searchsorted(lengths, np.arange(size + 2))  # next piece of each length
        sequence, offset = np.empty((2, len(lengths)), dtype=np.int64)
        base = table.column("group")[0].as_py() << 32
        for number, own in enumerate(best_two_fit(lengths, size)):
            at = 0
            for length in own:
                i = first[length]
                first[length] += 1
                sequence[i], offset[i] = base + number, at
                at += length
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, path: str, size: int = SEQUENCE_TOKENS, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    pieces = kept(rows.mapInArrow(_pieces(path, size, end), _PIECE + ", `row` long"), "pieces")
    groups = max(-(-pieces.count() // GROUP), 1)
    return (
        pieces.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
        .groupBy("group").applyInArrow(_packed(size), _PIECE + ", sequence_id long, offset long")
    )
