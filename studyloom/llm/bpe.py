"""Byte-pair encoding of whole texts with a segment tree over adjacent pairs.

A text is cut into the pieces that the vocabulary asks for. Each distinct piece
of a task is encoded once: the pairs of neighbouring symbols are the leaves of
a segment tree whose keys are (rank of the merge, place); the root is the
leftmost merge of lowest rank. A merge changes three leaves and their paths to
the root; the tree of a piece is done when its root holds no merge. The trees
of many pieces are kept as the rows of one array and take their steps together;
the last few, as of a long run of letters, are walked one by one.

The vocabulary file is that of a public tokenizer; its path is a parameter.
Special tokens in a text give their ids. Texts with characters beyond Latin
letters, digits and usual signs are normalized and cut by the library, the
merges are the same; ids equal the library's for the whole text. Byte-level
vocabularies have the other texts of a slice cut at once, by the kinds of their
bytes, and each distinct piece of the slice looked up once.

Null text reads as empty text. The pieces a task remembers are bounded by
``REMEMBERED``; what is dropped is only encoded again.
"""

from __future__ import annotations

import collections
import functools
import hashlib
import itertools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

REMEMBERED = 400_000
#: So few trees are quicker on plain lists than on arrays.
LONE = 48
NONE = np.iinfo(np.int64).max

# Texts of these characters need no help from the library: they are in composed
# form, and their letters and numbers can be listed.
_RANGE = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250))]
_LETTERS = "".join(c for c in _RANGE if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _RANGE if unicodedata.category(c)[0] == "N")
_FAMILIAR = re.compile("[\\t\\n\\r\x20-\x7e\xa1-\xac\xae-\u024f]*").fullmatch

# The patterns that cut a text before the merges of these vocabularies.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+"
_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"


# Kinds of characters that the byte-level pattern tells apart, and those that only the library can cut.
LETTER, NUMBER, SIGN, BLANK, STRANGE = range(5)


def _kind(char: str) -> int:
    if not _FAMILIAR(char):
        return STRANGE
    return LETTER if char in _LETTERS else NUMBER if char in _NUMBERS else BLANK if char in " \t\n\r" else SIGN


# by code point, as far as two bytes of UTF-8 go, and by byte; what follows the first byte of a longer one does not matter
_KIND = np.array([_kind(chr(c)) for c in range(0x800)], dtype=np.uint8)
_KIND_OF_BYTE = np.concatenate([_KIND[:0x80], np.full(0x60, SIGN), np.full(0x20, STRANGE)]).astype(np.uint8)


def cut_bytes(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces of many texts by the byte-level pattern, the first of each text, and which texts it could cut.

    The pattern's pieces follow one another without a gap, so it is enough to
    say where one begins: where the kind of character changes, unless a space
    goes with what follows; at the last blank of several if more text follows;
    before and after a contraction. The other texts have no pieces here.
    """
    data, offsets = W.raw(text)
    kind = _KIND_OF_BYTE[data]
    two = np.flatnonzero((data & 0xE0) == 0xC0)
    kind[two] = kind[two + 1] = _KIND[(data[two] & 0x1F).astype(np.int32) << 6 | (data[two + 1] & 0x3F)]
    blank = kind == BLANK
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = edge.copy()
    start[1:-1] |= (kind[1:] != kind[:-1]) & (blank[1:] | (data[:-1] != 32))
    start[1:-2] |= blank[1:-1] & blank[:-2] & ~blank[2:] & ~edge[2:-1]
    quote = np.flatnonzero(start[:-1] & (data == 39))
    left = offsets[np.searchsorted(offsets, quote, side="right")] - quote  # bytes of the text from there
    padded = np.concatenate([data, np.zeros(2, dtype=np.uint8)])
    one, pair = padded[quote + 1], padded[quote + 1].astype(np.uint16) << 8 | padded[quote + 2]
    for size, found in ((2, np.isin(one, list(b"stmd"))), (3, np.isin(pair, [0x7265, 0x7665, 0x6C6C]))):  # re, ve, ll
        at = quote[found & (left >= size)]
        start[at + 1] = False
        start[at + size] = True
    strange = np.flatnonzero((kind == STRANGE) | ((data == 60) & (padded[1:-1] == 124) & ~edge[1:]))
    plain = np.ones(len(text), dtype=bool)
    plain[np.searchsorted(offsets, strange, side="right") - 1] = False
    bounds = np.append(np.flatnonzero(start[:-1]), len(data)).astype(np.int32)
    first = np.searchsorted(bounds[:-1], offsets)
    pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data))
    if not plain.all():
        sizes = np.diff(first)
        pieces = pieces.filter(pa.array(np.repeat(plain, sizes)))
        first = np.concatenate([[0], np.cumsum(sizes * plain)])
    return pieces, first, plain


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """Merge table of a vocabulary and the trees that apply it."""

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str):
        symbols = byte_symbols()
        self.inner = np.array([vocabulary[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocabulary[s + end] for s in symbols], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        key = np.array([(vocabulary[a] << 32) | vocabulary[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        # two-choice probing table: a slot holds a key, its rank and what it makes
        bits = max(int(len(key) * 8).bit_length(), 4)
        self.shift = np.uint64(64 - bits)
        size = 1 << bits
        self.keys = np.full(size + 64, -1, dtype=np.int64)
        self.rank = np.full(size + 64, -1, dtype=np.int64)
        self.made = np.full(size + 64, -1, dtype=np.int64)
        self.known = {k: (r, m) for r, (k, m) in reversed(list(enumerate(zip(key.tolist(), made.tolist()))))}
        self.reach = 1
        for r, (k, m, slot) in enumerate(zip(key.tolist(), made.tolist(), self._slot(key).tolist())):
            step = 0
            while self.keys[slot + step] not in (-1, k):
                step += 1
            if self.keys[slot + step] == k:
                continue
            self.keys[slot + step], self.rank[slot + step], self.made[slot + step] = k, r, m
            self.reach = max(self.reach, step + 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(W.BASE)) >> self.shift).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair in the merge table, -1 for pairs that do not merge."""
        key = (a << 32) | b
        slot = self._slot(key)
        seen = self.keys[slot]
        at = np.where(seen == key, slot, -1)
        open_ = np.flatnonzero((seen != key) & (seen != -1))
        for step in range(1, self.reach):
            if not len(open_):
                break
            seen = self.keys[slot[open_] + step]
            hit = seen == key[open_]
            at[open_[hit]] = slot[open_[hit]] + step
            open_ = open_[~hit & (seen != -1)]
        return at

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, a non-empty byte string that merges do not leave."""
        out = [b""] * len(pieces)
        sizes = np.fromiter((len(p) for p in pieces), dtype=np.int64, count=len(pieces))
        width = np.left_shift(1, np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64))
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            step = max((1 << 18) // int(w), 1)
            for low in range(0, len(rows), step):
                some = rows[low : low + step]
                flat, counts = self._trees([pieces[i] for i in some], sizes[some], int(w))
                body, ends = flat.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
                for i, begin, end in zip(some.tolist(), [0, *ends], ends):
                    out[i] = body[begin:end]
        return out

    def _key(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """Leaf value: rank and place in one number, NONE where nothing merges."""
        at = self.lookup(left, right)
        return np.where(at >= 0, self.rank[at] * width + place, NONE)

    def _trees(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Row by row: symbols at flat places row * (width + 1), trees at row * 2 * width."""
        n = len(pieces)
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        line = width + 1
        column = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        owner = np.repeat(np.arange(n), sizes)
        symbol = np.full(n * line, -1, dtype=np.int64)
        symbol[owner * line + column] = self.inner[raw]
        symbol[np.arange(n) * line + sizes - 1] = self.final[raw[np.cumsum(sizes) - 1]]
        # neighbours of each place in its row; ``width`` stands for none
        steps = np.arange(1, line + 1)
        after = np.where(steps < sizes[:, None], steps, width).reshape(-1)
        before = np.tile(np.concatenate([[width], np.arange(width)]), n)
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        pair = np.flatnonzero(column + 1 < sizes[owner])
        r, c = owner[pair], column[pair]
        tree[r, width + c] = self._key(symbol[r * line + c], symbol[r * line + c + 1], c, width)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        tree = tree.reshape(-1)
        rows = np.arange(n)
        while True:
            root = tree[rows * (2 * width) + 1]
            rows, root = rows[root != NONE], root[root != NONE]
            if len(rows) <= LONE:
                for row in rows.tolist():
                    own = slice(row * line, (row + 1) * line)
                    lists = (x.tolist() for x in (symbol[own], after[own], before[own], tree[2 * width * row : 2 * width * (row + 1)]))
                    symbol[own] = self._walk(*lists, width)
                break
            at, top = rows * line, rows * (2 * width)
            place = root % width
            gone = after[at + place]
            following, preceding = after[at + gone], before[at + place]
            merged = self.made[self.lookup(symbol[at + place], symbol[at + gone])]
            symbol[at + place] = merged
            symbol[at + gone] = -1
            after[at + place] = following
            before[at + following] = place
            # the three leaves that change: the merged pair, the one it swallowed, the one before
            tree[top + width + gone] = NONE
            right = symbol[at + following]
            tree[top + width + place] = np.where(following < width, self._key(merged, right, place, width), NONE)
            has = np.flatnonzero(preceding < width)
            tree[top[has] + width + preceding[has]] = self._key(
                symbol[at[has] + preceding[has]], merged[has], preceding[has], width
            )
            a, b, c = width + place, width + gone, width + preceding[has]
            top_b, top_c, beside_b, beside_c = top, top[has], a, a[has]
            depth = width
            while depth > 1:
                depth //= 2
                a, b, c, beside_b, beside_c = a >> 1, b >> 1, c >> 1, beside_b >> 1, beside_c >> 1
                own = b != beside_b  # paths that have met need one update
                b, top_b, beside_b = b[own], top_b[own], beside_b[own]
                own = c != beside_c
                c, top_c, beside_c = c[own], top_c[own], beside_c[own]
                for base, node in ((top, a), (top_b, b), (top_c, c)):
                    child = base + 2 * node
                    tree[base + node] = np.minimum(tree[child], tree[child + 1])
        symbol = symbol.reshape(n, line)[:, :width]
        left = symbol >= 0
        return symbol[left], left.sum(axis=1)


    def _walk(self, symbol: list[int], after: list[int], before: list[int], tree: list[int], width: int) -> list[int]:
        """Symbols of one piece when its tree holds no more merges."""
        known, none = self.known, int(NONE)

        def put(place: int, left: int, right: int) -> None:
            found = known.get((left << 32) | right)
            value = none if found is None else found[0] * width + place
            node = width + place
            while node and tree[node] != value:
                tree[node] = value
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                value = a if a < b else b

        while tree[1] != none:
            place = tree[1] % width
            gone = after[place]
            merged = known[(symbol[place] << 32) | symbol[gone]][1]
            following, preceding = after[gone], before[place]
            symbol[place], symbol[gone] = merged, -1
            after[place], before[following] = following, place
            put(gone, -1, -1)
            put(place, merged, symbol[following] if following < width else -1)
            if preceding < width:
                put(preceding, symbol[preceding], merged)
        return symbol


class Encoder:
    """Pieces of a text to ids, equal to the library's ids for the whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            model = json.load(source)["model"]
        end = model.get("end_of_word_suffix") or ""
        self.merges = Merges(model["vocab"], model["merges"], end)
        self.lower = bool(end)
        self.pattern = re.compile((_WORD_PATTERN if end else _BYTE_PATTERN).format(L=_LETTERS, N=_NUMBERS))
        self.byte_of = {s: b for b, s in enumerate(byte_symbols())}
        self.token_bytes = {i: s.encode() for s, i in self.library.get_vocab(with_added_tokens=True).items()}
        special = self.library.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._remember(list(self.special), np.array(list(special), dtype="<u4"), np.arange(len(special) + 1))

    def _pieces(self, text: str) -> list[str]:
        """Strings that the merges of a text do not leave."""
        if "<|" in text and self.cut.search(text):
            found: list[str] = []
            for part in self.cut.split(text):
                found += [part] if part in self.special else self._pieces(part)
            return found
        if _FAMILIAR(text):
            return self.pattern.findall(text.lower() if self.lower else text)
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        return [bytes([self.byte_of[c] for c in p]).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _remember(self, pieces: list[str], ids: np.ndarray, first: np.ndarray) -> None:
        """Number some pieces; piece i has the ids from ``first[i]`` up to ``first[i + 1]``."""
        self.known = collections.defaultdict(None, zip(pieces, range(len(pieces))))
        self.known.default_factory = self.known.__len__  # a new piece gets the next number
        self.ids, self.first = ids, first

    def _learn(self) -> None:
        """Encode the pieces that have a number and no ids yet."""
        new = list(itertools.islice(self.known, len(self.first) - 1, None))
        if new:
            found = self.merges.encode([p.encode() for p in new])
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), dtype="<u4")])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pieces in a row, and where each piece begins."""
        sizes = self.first[numbers + 1] - self.first[numbers]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(self.first[numbers] - begin[:-1], sizes) + np.arange(begin[-1])], begin

    def _forget(self, numbers: np.ndarray) -> None:
        """Keep the special tokens and the pieces of some numbers."""
        keep = np.union1d(np.arange(len(self.special)), numbers)
        names = list(self.known)
        ids, first = self._gather(keep)
        self._remember([names[i] for i in keep.tolist()], ids, first)

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int32, count=len(pieces))

    def _rows(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the pieces of each text."""
        if self.lower:
            return [self._numbers(self._pieces(t)) for t in texts]
        pieces, first, plain = cut_bytes(pa.array(texts, pa.string()))
        found = pieces.dictionary_encode()  # each distinct piece is asked for once
        numbers = self._numbers(found.dictionary.to_numpy(zero_copy_only=False))[found.indices.to_numpy()]
        bounds = zip(first.tolist(), first[1:].tolist())
        return [numbers[a:b] if own else self._numbers(self._pieces(t)) for t, own, (a, b) in zip(texts, plain.tolist(), bounds)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        rows = self._rows(texts)
        self._learn()
        numbers = np.concatenate([np.zeros(0, dtype=np.int32), *rows])
        ids, begin = self._gather(numbers)
        body, ends = ids.tobytes(), (begin[np.cumsum([len(r) for r in rows], dtype=np.int64)] * 4).tolist()
        if len(self.known) > REMEMBERED:
            self._forget(numbers)
        return [body[a:b] for a, b in zip([0, *ends], ends)]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text of some ids, as the library decodes them with special tokens kept."""
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        if self.library.decoder is not None:
            return self.library.decode(numbers, skip_special_tokens=False).encode()
        return b" ".join([self.token_bytes[i] for i in numbers])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(batch: pa.RecordBatch, path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with the ids of their texts."""
    coder = encoder(path)
    for part in W.slices(batch, limit=4 << 20):
        yield part, coder.encode(W.texts_of(part.column("text")).to_pylist())


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part, ids in encoded(batch, path):
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids]),
                })

    return run


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part, ids in encoded(batch, path):
                bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), dtype="<i4")
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"),
                    "ids": pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)),
                    "decoded": pa.array([coder.decode(x).decode() for x in ids], pa.string()),
                })

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the decoded text of every row."""
    return _rows(docs).mapInArrow(_texts(path), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of the decoded text of every row."""
    return _rows(docs).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def crc32(ids: bytes | memoryview) -> int:
    return zlib.crc32(ids)
