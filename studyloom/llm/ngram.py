"""Bigram language model in Elias-Fano tries, built and asked in shards.

Text is words (A-Z lowered) and one end token; a start token is the context of
the first. With c the counts in the training texts, N tokens and V distinct
ones, p(w) = (c(w) + 1) / (N + V + 1) and

    p(w | v) = (c(v w) + K p(w)) / (c(v) + K).

K is the weight under which the training texts are likeliest when each token is
left out of its own counts (``fit_weight``). It is fitted on all training texts,
as are all counts; pairs are counted before they are dealt for that.

The logarithm splits into a part of (v, w) and one of v alone, and both are
known where all occurrences of a word are gathered. So the token occurrences
are dealt once, by the hash of the word w; a shard holds, for its words, a trie
from the word back to the contexts that precede it:

* level one: the word hashes in ascending order (Elias-Fano), the counts, the
  pointers to the children (monotone, Elias-Fano), the quantised logarithms of
  K p(w) and of c(w) + K;
* level two: the contexts of all words, ascending when the number of the word
  is put in front of the hash (Elias-Fano), and the quantised logarithms of
  c(v w) + K p(w).

The levels are flat arrays in a file of the task that is mapped into memory and
gone when the task ends. A lookup finds the word by successor search in level
one, then the context by successor search from the word's first child. The
shard answers with sums per document, which are added up per chunk of documents. The
model is as large as the corpus asks for, and no machine holds all of it.

A word with more than one in ``HOT`` of all tokens is dealt by word and context
to all shards; there are at most ``HOT`` such words, so their counts are sent
along. Words are told apart by 64-bit hashes, contexts by 32-bit hashes.

Null text is empty: one end token. Rows without id are not trained on and are
scored alike; every input row gives one output row.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import kept

#: Weights that are tried.
WEIGHTS = [2.0**i for i in range(0, 21)]
COUNTER_BYTES = 64 << 20  # text for one group of words in the first count
HOT = 1000
SHARD_TOKENS = 1_500_000
STEPS_PER_DECADE = 1024  # resolution of the quantised logarithms

END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and ends of some texts in a row, and the first of each text.

    What is needed per byte is held for one slice of the texts at a time.
    """
    found = [_tokens(W.texts_of(part.column("text"))) for part in W.slices(pa.record_batch({"text": text}))]
    sizes = [np.zeros(0, dtype=np.int64), *(np.diff(first) for _, first in found)]
    return (
        np.concatenate([np.zeros(0, dtype=np.uint64), *(hashes for hashes, _ in found)]),
        np.concatenate([[0], np.cumsum(np.concatenate(sizes))]),
    )


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = W.split(text)
    first = words.first + np.arange(len(words.first))
    out = np.empty(int(first[-1]), dtype=np.uint64)
    out[first[1:] - 1] = END
    inside = np.ones(len(out), dtype=bool)
    inside[first[1:] - 1] = False
    out[inside] = W.hashes(words, lower=True)
    return out, first


_ZEROS = np.array([8 - bin(b).count("1") for b in range(256)], dtype=np.int64)
_PLACE = np.zeros((256, 9), dtype=np.int64)  # place of the i-th zero bit of a byte
for _b in range(256):
    _free = [i for i in range(8) if not _b >> i & 1]
    _PLACE[_b, : len(_free)] = _free


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` low bits of each value, one after another in 64-bit words."""
    out = np.zeros((len(values) * width >> 6) + 2, dtype=np.uint64)
    if not width or not len(values):
        return out
    at = np.arange(len(values), dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    values = values & np.uint64((1 << width) - 1)
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[heads]] = np.bitwise_or.reduceat(values << shift, heads)
    over = np.flatnonzero(shift + np.uint64(width) > np.uint64(64))
    out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return out


class EliasFano:
    """Ascending 64-bit numbers: low bits packed, high bits in unary with a rank directory."""

    def __init__(self, low: np.ndarray, unary: np.ndarray, zeros: np.ndarray, width: int, count: int):
        self.low, self.unary, self.zeros, self.width, self.count = low, unary, zeros, width, count

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        span = int(values[-1]) + 1 if n else 1
        width = min(max((span // max(n, 1)).bit_length() - 1, 0), 63)
        place = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(place[-1]) + 2 if n else 1) + 63 & ~63, dtype=np.uint8)
        bits[place] = 1
        unary = np.packbits(bits, bitorder="little")
        zeros = np.concatenate([[0], np.cumsum(_ZEROS[unary].reshape(-1, 8).sum(axis=1))])
        return cls(_pack_bits(values, width), unary, zeros, width, n)

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.int64) * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift
        over = np.flatnonzero(shift + np.uint64(self.width) > np.uint64(64))
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return value & np.uint64((1 << self.width) - 1)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a high part up to ``high`` (-1: none), by selecting its zero."""
        high = np.minimum(high, self.zeros[-1] - 1)
        word = np.searchsorted(self.zeros, high, side="right") - 1
        rest = np.maximum(high - self.zeros[np.maximum(word, 0)], 0)
        at = np.maximum(word, 0) * 8
        for _ in range(7):
            step = _ZEROS[self.unary[at]]
            go = rest >= step
            rest = np.where(go, rest - step, rest)
            at = np.where(go, at + 1, at)
        return np.where(high < 0, 0, at * 8 + _PLACE[self.unary[at], rest] - high)

    def find(self, keys: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of each key by successor search, from ``first`` up to ``last`` if given; -1 where it is absent."""
        if not self.count:
            return np.full(len(keys), -1)
        high = (keys >> np.uint64(self.width)).astype(np.int64)
        low = keys & np.uint64((1 << self.width) - 1)
        beyond = high >= self.zeros[-1]
        a, b = self._before(high - 1), self._before(high)
        if first is not None:
            a, b = np.maximum(a, first), np.minimum(b, last)
        top = b.copy()
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                break
            middle = (a[open_] + b[open_]) >> 1
            less = self.low_bits(middle) < low[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
        found = (a < top) & ~beyond
        i = np.flatnonzero(found)
        found[i] = self.low_bits(a[i]) == low[i]
        return np.where(found, a, -1)


def quantise(x: np.ndarray) -> np.ndarray:
    return np.rint(np.log10(x) * STEPS_PER_DECADE).astype(np.int16)


class Trie:
    """Words and the contexts before them; see the module text for the levels."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, parents: np.ndarray, contexts: np.ndarray, pairs: np.ndarray, types: int, weight: float):
        """``words`` ascending with ``counts``; children by (parent, context) with counts ``pairs``."""
        self.weight = weight
        base = weight * (counts + 1) / types
        children = np.searchsorted(parents, np.arange(len(words) + 1)).astype(np.uint64)
        level1, pointers = EliasFano.of(words), EliasFano.of(children)
        level2 = EliasFano.of((parents.astype(np.uint64) << np.uint64(32)) | contexts.astype(np.uint64))
        parts = [
            *(x for level in (level1, pointers, level2) for x in (level.low, level.unary, level.zeros)),
            counts.astype(np.int64), quantise(base), quantise(counts + weight), quantise(pairs + base[parents]),
        ]
        with tempfile.TemporaryFile() as file:
            places = []
            for x in parts:
                file.write(b"\0" * (-file.tell() % 8))
                places.append(file.tell())
                file.write(np.ascontiguousarray(x).tobytes() or b"\0")
            file.flush()
            whole = np.memmap(file, dtype=np.uint8, mode="r")
        views = [whole[p : p + x.nbytes].view(x.dtype) for p, x in zip(places, parts)]
        self.level1 = EliasFano(*views[0:3], level1.width, level1.count)
        self.pointers = EliasFano(*views[3:6], pointers.width, pointers.count)
        self.level2 = EliasFano(*views[6:9], level2.width, level2.count)
        self.counts, self.backoff, self.total, self.joint = views[9:]
        self.unknown = float(np.rint(np.log10(weight / types) * STEPS_PER_DECADE))
        self.starts = self._pointers()

    def _pointers(self) -> np.ndarray:
        """All pointers, from the places of the ones in their unary part."""
        n = self.pointers.count
        high = np.flatnonzero(np.unpackbits(np.asarray(self.pointers.unary), bitorder="little"))[:n] - np.arange(n)
        low = self.pointers.low_bits(np.arange(n)).astype(np.int64)
        return (high << self.pointers.width) + low

    def look_up(self, words: np.ndarray, owner: np.ndarray, contexts: np.ndarray):
        """Counts and total logarithms of some words; joint logarithms of (word, context) pairs, words given by number."""
        if not self.level1.count:
            zero = np.zeros(len(words))
            return zero.astype(np.int64), zero + np.log10(self.weight), np.full(len(owner), self.unknown / STEPS_PER_DECADE)
        at = self.level1.find(words)
        known = at >= 0
        counts = np.where(known, self.counts[at], 0)
        total = np.where(known, self.total[at] / STEPS_PER_DECADE, np.log10(self.weight))
        parent, there = at[owner], known[owner]
        child = np.full(len(owner), -1)
        some = np.flatnonzero(there)
        child[some] = self.level2.find(
            (parent[some].astype(np.uint64) << np.uint64(32)) | contexts[some].astype(np.uint64),
            self.starts[parent[some]], self.starts[parent[some] + 1],
        )
        joint = np.where(there, self.backoff[parent], self.unknown)
        seen = child >= 0
        joint[seen] = self.joint[child[seen]]
        return counts, total, joint / STEPS_PER_DECADE


# --- passes -----------------------------------------------------------------------

_DEALT = "shard int, chunk long, rows binary, info binary, words binary, sizes binary, contexts binary, docs binary"
_PAIRS = "shard int, words binary, sizes binary, contexts binary, counts binary"
# sums of a chunk of texts in one shard, or (without sums) what is known of its texts
_PART = "chunk long, rows binary, info binary, words binary, sizes binary, contexts binary, known binary, base binary, score binary"
_TEXT = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _counted(shards: int):
    """Distinct words of each slice with their counts, overall and in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, limit=8 << 20):
                hashes, first = tokens(W.texts_of(part.column("text")))
                train = np.repeat(part.column("train").to_numpy(zero_copy_only=False), np.diff(first))
                order = np.argsort(hashes)
                hashes = hashes[order]
                heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                words, n = hashes[heads], np.diff(np.append(heads, len(hashes))).astype(np.uint32)
                own = np.add.reduceat(train[order], heads, dtype=np.uint32)
                del hashes, train, order, heads
                # words ascend, so shards are ranges of the hash
                shard = ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                cut = np.searchsorted(shard, np.arange(shards + 1))
                yield pa.record_batch({
                    "shard": pa.array(np.arange(shards, dtype=np.int32)),
                    **{
                        name: pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
                        for name, x in (("words", words), ("n", n), ("own", own))
                    },
                })

    return run


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)


def _totals(table: pa.Table) -> pa.Table:
    """Tokens, training tokens and training words of a shard, and its most frequent words."""
    words, inverse = np.unique(_joined(table, "words", np.uint64), return_inverse=True)
    n = np.bincount(inverse, weights=_joined(table, "n", np.uint32), minlength=len(words)).astype(np.int64)
    own = np.bincount(inverse, weights=_joined(table, "own", np.uint32), minlength=len(words)).astype(np.int64)
    top = np.flatnonzero(n * HOT > n.sum())
    return pa.table({
        "tokens": pa.array([int(n.sum())]), "trained": pa.array([int(own.sum())]), "types": pa.array([int((own > 0).sum())]),
        "ends": pa.array([int(own[words == END].sum())]),
        "top": pa.array([[{"w": w, "n": a, "own": b} for w, a, b in zip(words[top].view(np.int64).tolist(), n[top].tolist(), own[top].tolist())]],
                        pa.list_(pa.struct([("w", pa.int64()), ("n", pa.int64()), ("own", pa.int64())]))),
    })


def _placed(words: np.ndarray, first: np.ndarray, shards: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and shard of each token."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first[:-1]] = START
    spread = np.where(np.isin(words, hot), W.mix(words ^ (before * np.uint64(W.BASE))), words)
    shard = ((spread >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.uint16 if shards < 65536 else np.uint32)
    return (before >> np.uint64(32)).astype(np.uint32), shard


def _dealt(shards: int, hot: np.ndarray):
    """Occurrences of words with their contexts, by shard; and what is known of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, limit=8 << 20):
                words, first = tokens(W.texts_of(part.column("text")))
                context, shard = _placed(words, first, shards, hot)
                doc = np.repeat(np.arange(part.num_rows, dtype=np.uint32), np.diff(first))
                order = np.argsort(words)
                order = order[np.argsort(shard[order], kind="stable")]
                words, context, doc = words[order], context[order], doc[order]
                cut = np.searchsorted(shard[order], np.arange(shards + 1))
                rows = part.column("row").to_numpy()
                train = part.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)
                out: dict[str, list] = {c: [] for c in ("shard", "chunk", "rows", "info", "words", "sizes", "contexts", "docs")}
                for s, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
                    if a == b:
                        continue
                    heads = np.flatnonzero(np.concatenate([[True], words[a + 1 : b] != words[a : b - 1]]))
                    own, local = np.unique(doc[a:b], return_inverse=True)
                    out["shard"].append(s)
                    out["chunk"].append(int(rows[0]))
                    out["rows"].append(rows[own].tobytes())
                    out["info"].append(train[own].tobytes())
                    out["words"].append(words[a + heads].tobytes())
                    out["sizes"].append(np.diff(np.concatenate([heads, [b - a]])).astype(np.uint32).tobytes())
                    out["contexts"].append(context[a:b].tobytes())
                    out["docs"].append(local.astype(np.uint32 if len(own) > 65535 else np.uint16).tobytes())
                yield pa.record_batch(
                    {c: pa.array(x, {"shard": pa.int32(), "chunk": pa.int64()}.get(c, pa.binary())) for c, x in out.items()}
                )
                # the texts themselves, to any shard
                yield pa.record_batch({
                    "shard": pa.array([-1 - int(rows[0]) % shards], pa.int32()), "chunk": pa.array([int(rows[0])]), "rows": pa.array([rows.tobytes()], pa.binary()),
                    "info": pa.array([part.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary()),
                    "words": pa.array([np.diff(first).astype(np.int64).tobytes()], pa.binary()),
                    "sizes": pa.array([part.column("doc_id").fill_null(0).to_numpy().tobytes()], pa.binary()),
                    "contexts": pa.array([part.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary()),
                    "docs": pa.array([b""], pa.binary()),
                })

    return run


@dataclass
class Gathered:
    """All occurrences of the words of a shard, as pairs (number of the word, context) in ascending order."""

    words: np.ndarray
    counts: np.ndarray  # in training texts
    number: np.ndarray
    train: np.ndarray
    order: np.ndarray
    heads: np.ndarray
    word_of: np.ndarray
    context_of: np.ndarray
    pair_counts: np.ndarray


def _gathered(table: pa.Table, hot: np.ndarray, hot_counts: np.ndarray) -> Gathered:
    uniques, owner = np.unique(_joined(table, "words", np.uint64), return_inverse=True)
    number = np.repeat(owner.astype(np.int32), _joined(table, "sizes", np.uint32))
    context = _joined(table, "contexts", np.uint32)
    train = np.concatenate([
        np.frombuffer(i, dtype=np.uint8)[_local(d, i)] for i, d in zip(table.column("info").to_pylist(), table.column("docs").to_pylist())
    ])
    counts = np.bincount(number, weights=train, minlength=len(uniques)).astype(np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, uniques), len(hot) - 1)
        counts = np.where(hot[at] == uniques, hot_counts[at], counts)
    key = (number.astype(np.uint64) << np.uint64(32)) | context
    del context
    order = np.argsort(key)
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    pair_counts = np.add.reduceat(train[order].astype(np.int64), heads)
    word_of, context_of = (key[heads] >> np.uint64(32)).astype(np.int64), key[heads].astype(np.uint32)
    return Gathered(uniques, counts, number, train, order, heads, word_of, context_of, pair_counts)


def _pairs(shards: int, hot: np.ndarray):
    """Pairs (word, context) of a slice with their counts, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, limit=8 << 20):
                words, first = tokens(W.texts_of(part.column("text")))
                context, shard = _placed(words, first, shards, hot)
                order = np.lexsort((context, words))
                order = order[np.argsort(shard[order], kind="stable")]
                words, context, shard = words[order], context[order], shard[order]
                new_word = np.ones(len(words), dtype=bool)
                new_word[1:] = (words[1:] != words[:-1]) | (shard[1:] != shard[:-1])
                new_pair = new_word.copy()
                new_pair[1:] |= context[1:] != context[:-1]
                pairs, heads = np.flatnonzero(new_pair), np.flatnonzero(new_word[new_pair])
                counts = np.diff(np.append(pairs, len(words))).astype(np.uint32)
                sizes = np.diff(np.append(heads, len(pairs))).astype(np.uint32)
                words, context, shard = words[pairs][heads], context[pairs], shard[pairs]
                cut = np.searchsorted(shard, np.arange(shards + 1))
                cut_words = np.searchsorted(shard[heads], np.arange(shards + 1))
                own = np.flatnonzero(np.diff(cut))
                yield pa.record_batch({
                    "shard": pa.array(own.astype(np.int32)),
                    **{
                        name: pa.array([x[at[s] : at[s + 1]].tobytes() for s in own], pa.binary())
                        for name, x, at in (("words", words, cut_words), ("sizes", sizes, cut_words), ("contexts", context, cut), ("counts", counts, cut))
                    },
                })

    return run


def _likelihood(hot: np.ndarray, hot_counts: np.ndarray, types: int):
    """Log likelihood of the training tokens of a shard under each weight, each token left out of its counts."""

    def run(table: pa.Table) -> pa.Table:
        words, owner = np.unique(_joined(table, "words", np.uint64), return_inverse=True)
        key = np.repeat(owner.astype(np.uint64), _joined(table, "sizes", np.uint32)) << np.uint64(32)
        key |= _joined(table, "contexts", np.uint32)
        order = np.argsort(key)
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.add.reduceat(_joined(table, "counts", np.uint32)[order].astype(np.int64), heads)
        word_of = (key[heads] >> np.uint64(32)).astype(np.int64)
        del key, order
        here = np.bincount(word_of, weights=n, minlength=len(words)).astype(np.int64)
        counts = here
        if len(hot):
            at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
            counts = np.where(hot[at] == words, hot_counts[at], here)
        rest, here = counts[word_of] / (types - 1), here * (words != END)
        found = []
        for weight in WEIGHTS:
            joint = (n * np.log(n - 1 + weight * rest)).sum()
            found.append(float(joint - (here * np.log(np.maximum(counts - 1, 0) + weight)).sum()))
        return pa.table({"weight": pa.array(WEIGHTS), "likelihood": pa.array(found)})

    return run


def _scored(hot: np.ndarray, hot_counts: np.ndarray, types: int, weight: float):
    """Build the trie of a shard and sum up what its words add to each text."""

    def texts(table: pa.Table) -> pa.Table:
        nothing = pa.nulls(table.num_rows, pa.binary())
        return table.select(["chunk", "rows", "info", "words", "sizes", "contexts"]).append_column("known", nothing).append_column(
            "base", nothing
        ).append_column("score", nothing)

    def run(table: pa.Table) -> pa.Table:
        if table.column("shard")[0].as_py() < 0:
            return texts(table)
        g = _gathered(table, hot, hot_counts)
        uniques, counts, number, order, heads = g.words, g.counts, g.number, g.order, g.heads
        word_of, context_of, pair_counts = g.word_of, g.context_of, g.pair_counts
        del g
        in_trie = np.flatnonzero(counts > 0)
        renumber = np.cumsum(counts > 0) - 1
        kept_pairs = pair_counts > 0
        trie = Trie(
            uniques[in_trie], counts[in_trie], renumber[word_of[kept_pairs]], context_of[kept_pairs], pair_counts[kept_pairs], types, weight
        )
        c, total, joint = trie.look_up(uniques, word_of, context_of)
        score = np.empty(len(order))
        score[order] = np.repeat(joint, np.diff(np.concatenate([heads, [len(order)]])))
        # a word is also the context of the next one, an end is not
        score -= np.where(uniques == END, 0.0, total)[number]
        base, known = np.log10(c + 1.0), (c > 0).astype(np.float64)
        del order, trie
        out, at = [], 0
        for docs, info in zip(*(table.column(x).to_pylist() for x in ("docs", "info"))):
            local = _local(docs, info)
            part = slice(at, at + len(local))
            at += len(local)
            own = number[part]
            out.append([np.bincount(local, weights=x, minlength=len(info)).tobytes() for x in (known[own], base[own], score[part])])
        nothing = pa.nulls(table.num_rows, pa.binary())
        return pa.table({
            "chunk": table.column("chunk"), "rows": table.column("rows"), "info": nothing, "words": nothing, "sizes": nothing, "contexts": nothing,
            **{name: pa.array(x, pa.binary()) for name, x in zip(("known", "base", "score"), zip(*out))},
        })

    return run


def _added_up(table: pa.Table) -> pa.Table:
    """Sums of all shards for the texts of a chunk."""
    parts = table.to_pylist()
    own = next(p for p in parts if p["known"] is None)
    rows, n = np.frombuffer(own["rows"], dtype=np.int64), np.frombuffer(own["words"], dtype=np.int64)
    sums = np.zeros((3, len(rows)))
    for p in parts:
        if p["known"] is not None:
            at = np.searchsorted(rows, np.frombuffer(p["rows"], dtype=np.int64))
            for total, name in zip(sums, ("known", "base", "score")):
                total[at] += np.frombuffer(p[name])
    return pa.table({
        "doc_id": pa.array(np.frombuffer(own["sizes"], dtype=np.int64), mask=np.frombuffer(own["contexts"], dtype=np.uint8).astype(bool)),
        "held_out": pa.array(np.frombuffer(own["info"], dtype=np.uint8).astype(bool)), "n_tokens": pa.array(n),
        "n_known": pa.array(sums[0].astype(np.int64)), "base": pa.array(sums[1]), "score": pa.array(sums[2]),
    })


def _local(docs: bytes, info: bytes) -> np.ndarray:
    return np.frombuffer(docs, dtype=np.uint32 if len(info) > 65535 else np.uint16)


def fit_weight(rows: DataFrame, shards: int, hot: np.ndarray, hot_counts: np.ndarray, types: int, ends: int) -> float:
    """The weight of ``WEIGHTS`` under which the training tokens are likeliest.

    A row per shard and weight is added up; of several best weights the smallest counts.
    """
    found = rows.where("train").select("text").mapInArrow(_pairs(shards, hot), _PAIRS).groupBy("shard").applyInArrow(
        _likelihood(hot, hot_counts, types), "weight double, likelihood double"
    )
    sums = {r["weight"]: r["total"] for r in found.groupBy("weight").agg(F.sum("likelihood").alias("total")).collect()}
    # starts of texts are contexts in no shard
    return max(WEIGHTS, key=lambda k: (sums.get(k, 0.0) - ends * np.log(max(ends - 1, 0) + k), -k))


def score(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``held_out`` is a condition on doc_id; where it is false the text is trained on.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(~held_out, F.lit(False)).alias("train"),
        F.monotonically_increasing_id().alias("row"),
    )
    spark = docs.sparkSession
    # groups of words by the size of the texts, so that each stays small
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // COUNTER_BYTES))
    counted = rows.select("text", "train").mapInArrow(_counted(counters), "shard int, words binary, n binary, own binary")
    totals = kept(
        counted.groupBy("shard").applyInArrow(
            _totals, "tokens long, trained long, types long, ends long, top array<struct<w: long, n: long, own: long>>"
        ),
        "totals",
    )
    size, trained, types, ends = totals.agg(F.sum("tokens"), F.sum("trained"), F.sum("types"), F.sum("ends")).first()
    size, trained, types, ends = size or 0, trained or 0, types or 0, ends or 0
    # at most HOT words can hold more than one in HOT of all tokens
    frequent = totals.select(F.inline("top")).where(F.col("n") * HOT > size).collect()
    hot = np.array([r.w for r in frequent], dtype=np.int64).view(np.uint64)
    hot_counts = np.array([r.own for r in frequent], dtype=np.int64)[np.argsort(hot)]
    hot = np.sort(hot)
    shards = max(-(-size // SHARD_TOKENS), 1)
    weight = fit_weight(rows, shards, hot, hot_counts, trained + types + 1, ends)
    parts = rows.mapInArrow(_dealt(shards, hot), _DEALT).groupBy("shard").applyInArrow(
        _scored(hot, hot_counts, trained + types + 1, weight), _PART
    )
    start = float(np.log10(ends + weight))
    return parts.groupBy("chunk").applyInArrow(_added_up, _TEXT).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(trained + types + 1)))).alias("base_score"),
        (F.col("score") - F.lit(start)).alias("score"),
    )
