"""Repeated passages across documents, found by seed and extend.

A window is ``length`` consecutive words. Among the 10-word grams of a window
the one with the smallest hash (the rightmost, if several) is its anchor, so
equal windows have equal anchors at equal places. Documents are joined on
anchors, never on all windows. Each shared anchor is extended to both sides, as
far as its own windows reach, against one occurrence, the pivot: one in the
smallest document that holds the anchor. The result is the maximal run of
windows that both have. Windows that reach past a difference from the pivot are
compared among each other: occurrences that differ at the same place by the same
word are a class, which has a pivot of its own in the next round. An occurrence
sends out two ranges a round at most, and every round looks one word further at
least. Classes of up to ``TOGETHER`` occurrences are settled at once, in one
task. So work stays linear in the number of occurrences, whatever the size of a
group, and no equal window is missed.

Words travel as 32-bit hashes in the extension.

Rows: null or empty text has no words and stays as it is. A row without id
takes no part: nothing is removed from it or because of it. Rows with the same
id are one document; each gets its own result. Every input row gives one
output row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import kept

WINDOW_WORDS = 50
GRAM_WORDS = 10
TOGETHER = 256

_SEED = "struct<h: long, pos: int, first: int, last: int>"


def _anchors(values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the rightmost minimum in each run of ``span`` values."""
    place = np.arange(len(values))
    width = 1
    while width * 2 <= span:
        right = values[width:] <= values[:-width]
        place = np.where(right, place[width:], place[:-width])
        values = np.where(right, values[width:], values[:-width])
        width *= 2
    rest = span - width
    if rest:
        right = values[rest:] <= values[:-rest]
        place = np.where(right, place[rest:], place[:-rest])
    return place


def _scan(length: int):
    span = length - GRAM_WORDS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                words = W.split(W.texts_of(part.column("text")))
                hashes = W.hashes(words)
                grams, first_gram = W.shingles(hashes, words.first, GRAM_WORDS)
                per_text = words.per_text
                counts = np.zeros(len(per_text), dtype=np.int64)
                columns: list[list[np.ndarray]] = [[], [], [], []]
                digests = []
                for i, n in enumerate(per_text):
                    digests.append(hashlib.sha256(_joined(words, i)).hexdigest())
                    if n < length:
                        continue
                    own = grams[first_gram[i] : first_gram[i + 1]]
                    place = _anchors(own, span)
                    heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                    counts[i] = len(heads)
                    columns[0].append(own[place[heads]].view(np.int64))
                    columns[1].append(place[heads])
                    columns[2].append(heads)
                    columns[3].append(np.concatenate([heads[1:], [len(place)]]) - 1)
                h, pos, first, last = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in columns)
                seeds = pa.StructArray.from_arrays(
                    [pa.array(h), *(pa.array(x.astype(np.int32)) for x in (pos, first, last))], ["h", "pos", "first", "last"]
                )
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"),
                    "t": part.column("t"),
                    "n_words": pa.array(per_text.astype(np.int64)),
                    "whole_sha256": pa.array(digests),
                    "seeds": pa.ListArray.from_arrays(offsets, seeds),
                })

    return run


def _joined(words: W.Words, i: int, keep: np.ndarray | None = None) -> bytes:
    """Words of one text, or those of them to keep, joined by one blank."""
    text = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes()
    if keep is None:
        return b" ".join(text.split())
    return b" ".join([w for w, k in zip(text.split(), keep.tolist()) if k])


def _contexts(length: int):
    """For each seed of a document, the words of the windows it is the anchor of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                words = W.split(W.texts_of(part.column("text")))
                short = W.hashes(words).astype(np.uint32)
                seeds = part.column("seeds")
                n = np.diff(np.frombuffer(seeds.buffers()[1], dtype=np.int32)[seeds.offset : seeds.offset + len(seeds) + 1])
                flat = seeds.flatten()
                row = np.repeat(np.arange(part.num_rows), n)
                begin = words.first[row] + flat.field("first").to_numpy(zero_copy_only=False)
                size = flat.field("last").to_numpy(zero_copy_only=False) - flat.field("first").to_numpy(zero_copy_only=False) + length
                if not len(row):
                    continue
                offsets = np.concatenate([[0], np.cumsum(size)])
                # a bounded number of seeds at a time, as contexts overlap
                low = 0
                while low < len(row):
                    high = max(int(np.searchsorted(offsets, offsets[low] + (1 << 20), side="right")) - 1, low + 1)
                    total = offsets[high] - offsets[low]
                    at = np.arange(total) + np.repeat(begin[low:high] - (offsets[low:high] - offsets[low]), size[low:high])
                    body = short[at]
                    bounds = ((offsets[low : high + 1] - offsets[low]) * 4).astype(np.int32)
                    yield pa.record_batch({
                        "h": flat.field("h").slice(low, high - low),
                        "pivot": flat.field("pivot").slice(low, high - low),
                        "doc_id": part.column("doc_id").take(pa.array(row[low:high])),
                        "t": part.column("t").take(pa.array(row[low:high])),
                        "pos": flat.field("pos").slice(low, high - low),
                        "first": flat.field("first").slice(low, high - low),
                        "words": pa.BinaryArray.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(bounds), pa.py_buffer(body)]),
                    })
                    low = high

    return run


_FOUND = "doc_id long, t long, low int, high int, h long, pos int, first int, words binary"


def _class(h: int, side: int, distance: int, word: int) -> int:
    """Name of the occurrences of a class that first differ from its pivot by this word at this place."""
    x = W.mix(np.array([h & (1 << 64) - 1], dtype=np.uint64) + np.uint64(2 * distance + side))
    return int(W.mix(x ^ np.uint64(word)).view(np.int64)[0])


def _extend(length: int):
    """Grow each occurrence to both sides against the pivot of its class.

    Gives words [low, high) to remove where the pivot lies in a smaller
    document. Windows that reach past the first difference go on in a class of
    their own: those past the one on the left, and of the others those past the
    one on the right. Whatever window two occurrences share, they differ from
    the pivot at the same place and by the same word in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            names = ("h", "doc_id", "t", "pos", "first", "words", "pivot", "p_pos", "p_first", "p_words")
            for h, doc, t, pos, first, own, pivot, p_pos, p_first, other in zip(*(batch.column(c).to_pylist() for c in names)):
                back, p_back = pos - first, p_pos - p_first
                if own == other and back == p_back:
                    if doc > pivot:
                        out.append((doc, t, first, first + len(own) // 4, None, None, None, None))
                    continue
                a, b = np.frombuffer(own, dtype=np.uint32), np.frombuffer(other, dtype=np.uint32)
                reach = min(back, p_back)
                differ = a[back - reach : back] != b[p_back - reach : p_back]
                left = int(differ[::-1].argmax()) if differ.any() else reach
                reach = min(len(a) - back, len(b) - p_back)
                differ = a[back : back + reach] != b[p_back : p_back + reach]
                right = int(differ.argmax()) if differ.any() else reach
                low, high, last = pos - left, pos + right, first + len(a) - length
                if high - low >= length and doc > pivot:
                    out.append((doc, t, low, high, None, None, None, None))
                # begins of the windows past the left end, then of those past the right end only
                for side, distance, begin, end in ((0, left, first, low - 1), (1, right, max(low, high - length + 1), last)):
                    if begin <= end:
                        word = int(a[low - 1 - first] if side == 0 else a[high - first])
                        body = a[begin - first : end - first + length].tobytes()
                        out.append((doc, t, None, None, _class(h, side, distance, word), pos, begin, body))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.record_batch(columns, names=[f.split()[0] for f in _FOUND.split(", ")])

    return run


def _window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of every run of ``length`` of these words."""
    up, down = W._powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum((words.astype(np.uint64) + np.uint64(1)) * up[: len(words)], out=sums[1:])
    count = len(words) - length + 1
    return W.mix((sums[length:] - sums[:count]) * down[:count])


def _settle(length: int):
    """Words to remove in classes that come whole and in the order of ``h``."""

    def settled(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, doc, t, first = (batch.column(c).to_numpy() for c in ("h", "doc_id", "t", "first"))
        windows = [_window_hashes(np.frombuffer(x, dtype=np.uint32), length) for x in batch.column("words").to_pylist()]
        sizes = np.array([len(w) for w in windows])
        row = np.repeat(np.arange(len(sizes)), sizes)
        start = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = W.mix(np.concatenate(windows) + h[row].view(np.uint64) * np.uint64(W.BASE))
        order = np.lexsort((doc[row], key))
        heads = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        least = np.empty(len(row), dtype=np.int64)
        least[order] = np.repeat(doc[row][order][heads], np.diff(np.append(heads, len(row))))
        gone = np.flatnonzero(doc[row] > least)
        # windows one after the other are one run
        begin = np.concatenate([[True], (np.diff(gone) != 1) | (np.diff(row[gone]) != 0)])[: len(gone)]
        low = gone[begin]
        high = gone[np.append(np.flatnonzero(begin)[1:] - 1, len(gone) - 1)] if len(gone) else gone
        return pa.record_batch({
            "doc_id": pa.array(doc[row[low]]), "t": pa.array(t[row[low]]),
            "low": pa.array(start[low].astype(np.int32)), "high": pa.array((start[high] + length).astype(np.int32)),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            h = rows.column("h").to_numpy()
            # the last class may go on in the next batch
            last = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
            held = rows.slice(last)
            if last:
                yield settled(rows.slice(0, last).combine_chunks().to_batches()[0])
        if held is not None:
            yield settled(held.combine_chunks().to_batches()[0])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch):
            words = W.split(W.texts_of(part.column("text")))
            removed, texts = [], []
            for i, n in enumerate(words.per_text):
                ends = part.column("runs")[i].as_py()
                steps = np.zeros(n + 1, dtype=np.int32)
                np.add.at(steps, [r["low"] for r in ends], 1)
                np.add.at(steps, [r["high"] for r in ends], -1)
                keep = np.cumsum(steps[:-1]) == 0
                removed.append(int(n - keep.sum()))
                texts.append(_joined(words, i, keep).decode())
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "t": part.column("t"),
                "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.string()),
            })


def _against_pivots(contexts: DataFrame) -> DataFrame:
    """Occurrences beside one of those of their class in its smallest document."""
    own = contexts.where("doc_id = pivot").withColumn("place", F.xxhash64("t", "pos"))
    place = kept(own.groupBy("h").agg(F.min("place").alias("place")), "places")
    pivots = own.join(place, ["h", "place"]).select(
        "h", F.col("pos").alias("p_pos"), F.col("first").alias("p_first"), F.col("words").alias("p_words")
    )
    return contexts.join(kept(pivots, "pivots"), "h")


def repeated_passages(docs: DataFrame, length: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """Words that repeat a window of a document with a smaller id.

    Returns (rows, edits): ``rows`` has doc_id, t (a hash of the text), n_words
    and whole_sha256 of every row of ``docs``; ``edits`` has doc_id, t,
    n_removed and kept_text of the texts that lose words, once for each.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("t"),
    )
    rows = kept(
        docs.mapInArrow(_scan(length), f"doc_id long, t long, n_words long, whole_sha256 string, seeds array<{_SEED}>"), "anchors"
    )
    seeds = rows.where("doc_id IS NOT NULL").select("doc_id", "t", F.explode("seeds").alias("s")).select("doc_id", "t", "s.*")
    shared = kept(
        seeds.groupBy("h").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("top")).where("pivot <> top").drop("top"),
        "shared",
    )
    own = seeds.join(shared, "h").groupBy("doc_id", "t").agg(
        F.collect_set(F.struct("h", "pos", "first", "last", "pivot")).alias("seeds")
    )
    involved = kept(
        docs.where("doc_id IS NOT NULL").join(kept(own, "seeds"), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]), "involved"
    )
    contexts = kept(
        involved.mapInArrow(_contexts(length), "h long, pivot long, doc_id long, t long, pos int, first int, words binary"),
        "contexts",
    )
    runs = None
    while True:
        found = kept(_against_pivots(contexts).mapInArrow(_extend(length), _FOUND), "found")
        ends = found.where("h IS NULL").select("doc_id", "t", "low", "high")
        runs = ends if runs is None else runs.union(ends)
        loose = found.where("h IS NOT NULL").select("h", "doc_id", "t", "pos", "first", "words")
        shared = kept(
            loose.groupBy("h").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("top"), F.count("*").alias("n"))
            .where("pivot <> top").drop("top"),
            "shared",
        )
        small = loose.join(shared.where(f"n <= {TOGETHER}").select("h"), "h").select("h", "doc_id", "t", "first", "words")
        settled = small.repartition("h").sortWithinPartitions("h").mapInArrow(_settle(length), "doc_id long, t long, low int, high int")
        runs = runs.union(kept(settled, "settled"))
        shared = shared.where(f"n > {TOGETHER}").drop("n")
        if not shared.limit(1).count():
            break
        contexts = kept(loose.join(shared, "h"), "contexts")
    grouped = kept(
        runs.distinct().groupBy("doc_id", "t").agg(F.collect_list(F.struct("low", "high")).alias("runs")), "runs"
    )
    edits = kept(
        involved.drop("seeds").join(grouped, ["doc_id", "t"])
        .mapInArrow(_cut, "doc_id long, t long, n_removed long, kept_text string"),
        "edits",
    )
    return rows.drop("seeds"), edits


def removal_report(docs: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``."""
    rows, edits = repeated_passages(docs, length)
    cut = kept(edits.select("doc_id", "t", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("cut_sha256")), "cuts")
    return rows.join(cut, ["doc_id", "t"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with the repeated words cut from the texts.

    A text that loses words becomes its other words joined by one blank, with
    n_chars to match; other texts stay as they are. A document of which nothing
    is left is dropped.
    """
    _, edits = repeated_passages(docs, length)
    d, e = docs.alias("d"), edits.alias("e")
    rows = d.join(
        e, (F.col("d.doc_id") == F.col("e.doc_id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("e.t")), "left"
    )
    new = F.col("e.kept_text")
    changed = {"text": F.coalesce(new, "d.text"), "n_chars": F.coalesce(F.char_length(new).cast("long"), "d.n_chars")}
    return rows.where(new.isNull() | (new != "")).select(
        *[changed[c].alias(c) if c in changed else F.col(f"d.`{c}`") for c in docs.columns]
    )
