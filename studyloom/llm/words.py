"""Words of whole texts as numpy arrays, for use inside Arrow batches.

A word is a run of bytes other than blank and the controls 9 to 13. All steps
work on the bytes of many texts at once; memory is bounded by slicing batches
by bytes (a single longer text is hashed block by block).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
BLOCK_BYTES = 1 << 20

BASE = 0x9E3779B97F4A7C15
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if len(_tables.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _tables[name] = np.cumprod(factors, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null reads as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column, "") if column.null_count else column


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the n+1 offsets of the texts in them."""
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], dtype=kind)[text.offset : text.offset + len(text) + 1]
    offsets = offsets.astype(np.int64) if len(text) else np.zeros(1, dtype=np.int64)
    if text.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    _, offsets = raw(texts_of(batch.column(column)))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


@dataclass
class Words:
    """Words of some texts: byte ranges, and the first word of each text."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.per_text)


def split(text: pa.Array, space: np.ndarray = IS_SPACE) -> Words:
    """Words between the bytes that ``space`` marks."""
    data, offsets = raw(text)
    solid = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        before[0], after[-1] = False, False
        before[1:] = solid[:-1]
        after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; ranges are in ascending, nearly disjoint order."""
    out = np.empty(len(starts), dtype=np.uint64)
    begin = 0
    while begin < len(starts):
        stop = int(np.searchsorted(ends, starts[begin] + BLOCK_BYTES, side="right"))
        stop = min(max(stop, begin + 1), len(starts))
        low, high = int(starts[begin]), int(ends[stop - 1])
        up, down = _powers(high - low + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        part = data[low:high].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: high - low]
        np.cumsum(part, out=sums[1:])
        a, b = starts[begin:stop] - low, ends[begin:stop] - low
        out[begin:stop] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        begin = stop
    return mix(out)


def hashes(words: Words, lower: bool = False) -> np.ndarray:
    return range_hashes(LOWER[words.data] if lower else words.data, words.starts, words.ends)


def shingles(word_hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the first run of each text.

    A text with fewer words has one run, its whole sequence; a text without
    words has none.
    """
    n = np.diff(first)
    total = len(word_hashes)
    last = np.repeat(first[1:], n)
    at = np.arange(total)
    keep = (at + size <= last) | (at == np.repeat(first[:-1], n))
    at = at[keep]
    last = last[keep]
    factor = 1
    sums = np.zeros(len(at), dtype=np.uint64)
    for j in range(size):
        factor = factor * BASE % (1 << 64)
        if j == 0:
            sums += word_hashes[at] * np.uint64(factor)
            continue
        inside = at + j < last
        if inside.all():
            sums += word_hashes[at + j] * np.uint64(factor)
        else:
            sums[inside] += word_hashes[at[inside] + j] * np.uint64(factor)
    runs = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    return mix(sums), np.concatenate([[0], np.cumsum(runs)])
