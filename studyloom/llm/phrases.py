"""Phrase collocations: Apriori-safe candidates, counted by broadcast double-array tries.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those
into words ``[^\\x20\\x09]+``. Everything is per language (null: ``und``).

Candidates. A phrase occurs at least ``least`` times only if all its parts do.
For each length the hashes of the phrases seen are counted, but only where the
parts one word shorter passed; that filter is a bit map of hashes, so it lets
some others in and keeps none out. A last look collects the phrases themselves;
each is given out by the documents that share the smallest of the document
numbers (16 bits of a hash) it was seen in, so a phrase that is everywhere is not
sent by every task.

Counts. The candidates are dealt into shards of at most ``SHARD`` phrases. A
shard becomes a double-array trie over its words: state s goes with word code c
to base[s] + c where check holds s. The trie is broadcast; all positions of a
slice of text take their steps together, one level after the other, and the
states that accept are counted with bincount. Tasks give out their counts as
blocks of ``BLOCK`` numbers, and Spark adds the blocks up, in two steps.

Scores are computed in decimals of 38 digits, which hold 1000 * a * n exactly.

What is broadcast is bounded by ``SHARD`` and ``MOST_BITS``, whatever the corpus
holds: beyond ``SHARD`` candidates the texts are read once per shard, and beyond
``2^MOST_BITS / SPARSE`` frequent phrases the bit maps let more others in, which
the counts drop. Words are told apart by 64-bit hashes of their bytes and language.

Rows: a null or empty text has no words. Rows without id, of the same id and
repeated rows count one by one; ids and other columns are not read. Ties are
broken by count and then by phrase in byte order. An empty table, and a language
without a phrase of ``least`` occurrences, give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.operators.ordered import first_n

from . import words as W
from .tables import empty, kept

LONGEST = 5
LEAST = 100
TOP = 2000
#: Phrases in one trie.
SHARD = 1 << 18
#: Bits of a bit map: this many for each phrase that can be frequent, within bounds.
SPARSE = 32
LEAST_BITS, MOST_BITS = 20, 30
#: Distinct phrases that a task holds before it gives out its sums.
HELD = 1 << 20
#: Rows that a task gives out at a time.
GIVEN = 1 << 16
#: Counts in a block, and groups of tasks whose blocks are added up first.
BLOCK = 4096
GROUPS = 64
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, *b".,;:!?"]] = True
_BREAK = _SPACE.copy()
_BREAK[[0x20, 0x09]] = False


@dataclass
class Text:
    """Words of a slice of texts: their symbols, how many words follow each in its piece, and the number of their text."""

    words: W.Words
    symbols: np.ndarray
    follow: np.ndarray
    document: np.ndarray


def _symbols(hashes: np.ndarray, languages: np.ndarray) -> np.ndarray:
    """64-bit hash of a word and its language; the two take different parts, as a word may be a language's name."""
    return W.mix(hashes ^ W.mix(languages + np.uint64(W.BASE)))


def _language_hashes(column: pa.Array) -> np.ndarray:
    data, offsets = W.raw(column)
    return W.range_hashes(data, offsets[:-1], offsets[1:])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Text]]:
    for batch in batches:
        for part in W.slices(batch, limit=SLICE_BYTES):
            words = W.split(W.texts_of(part.column("text")), _SPACE)
            words.data = W.LOWER[words.data]
            n = len(words.starts)
            owner = words.text_of_word()
            hashes = W.range_hashes(words.data, words.starts, words.ends)
            breaks = np.concatenate([[0], np.cumsum(_BREAK[words.data], dtype=np.int32)])
            linked = np.zeros(n, dtype=bool)
            if n:
                linked[:-1] = (breaks[words.starts[1:]] == breaks[words.ends[:-1]]) & (owner[1:] == owner[:-1])
            # how many words follow without a break, up to LONGEST - 1
            follow = np.zeros(n, dtype=np.int8)
            run = linked.copy()
            for step in range(1, min(LONGEST, n)):
                follow[run] = step
                run[: n - step] &= linked[step:]
                run[n - step :] = False
            number = W.range_hashes(words.data, words.offsets[:-1], words.offsets[1:]) >> np.uint64(48)
            languages = _language_hashes(part.column("lang"))
            yield part, Text(words, _symbols(hashes, languages[owner]), follow, number.astype(np.uint16)[owner])


def _hashed(symbols: np.ndarray, lengths: Sequence[int]) -> dict[int, np.ndarray]:
    """63-bit hash of the phrase of each length that begins at each word."""
    out, factor, sums = {}, 1, np.zeros(len(symbols), dtype=np.uint64)
    for k in range(1, max(lengths) + 1):
        factor = factor * W.BASE % (1 << 64)
        sums[: max(len(symbols) - k + 1, 0)] += symbols[k - 1 :] * np.uint64(factor)
        if k in lengths:
            out[k] = W.mix(sums + np.uint64(k)) >> np.uint64(1)
    return out


class _Sums:
    """Counts of hashes that a task holds back, and the smallest document number of each."""

    def __init__(self):
        self.keys = np.zeros(0, dtype=np.uint64)
        self.counts = np.zeros(0, dtype=np.int64)
        self.documents = np.zeros(0, dtype=np.uint16)

    def add(self, hashes: np.ndarray, documents: np.ndarray) -> np.ndarray:
        """Count some hashes; gives the places of those not held so far, one of each."""
        order = np.argsort(hashes, kind="stable")
        sorted_ = hashes[order]
        heads = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])[: len(order)])
        keys, counts = sorted_[heads], np.diff(np.append(heads, len(order)))
        least = np.minimum.reduceat(documents[order], heads) if len(heads) else documents[:0]
        at = np.searchsorted(self.keys, keys)
        old = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        old[inside] = self.keys[at[inside]] == keys[inside]
        self.counts[at[old]] += counts[old]
        self.documents[at[old]] = np.minimum(self.documents[at[old]], least[old])
        new = ~old
        self.keys = np.insert(self.keys, at[new], keys[new])
        self.counts = np.insert(self.counts, at[new], counts[new])
        self.documents = np.insert(self.documents, at[new], least[new])
        return order[heads[new]]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(self.keys), GIVEN):
            part = slice(low, low + GIVEN)
            yield pa.record_batch({
                "key": pa.array(self.keys[part].view(np.int64)), "n": pa.array(self.counts[part]),
                "document": pa.array(self.documents[part].astype(np.int32)),
            })


def _bit(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = (len(bitmap) * 8).bit_length() - 1
    at = hashes >> np.uint64(63 - bits)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


# the three lowest bits of a key are the length of its phrase
_COUNTED = "key long, n long, document int"


def _keyed(hashes: np.ndarray, length: int) -> np.ndarray:
    return (hashes & ~np.uint64(7)) | np.uint64(length)


def _marked(keys: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """63-bit hash of a key and a document number."""
    return W.mix(keys + W.mix(documents.astype(np.uint64) + np.uint64(1))) >> np.uint64(1)


def _seen(lengths: Sequence[int], filtered: int = 0, bitmap=None) -> Callable:
    """Sums of the keys of phrases of some lengths whose parts of ``filtered`` words have their bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bitmap is None else bitmap.value
        sums = {k: _Sums() for k in lengths}
        for _, text in _texts(batches):
            hashes = _hashed(text.symbols, [*lengths, filtered] if filtered else lengths)
            if filtered:
                good = (text.follow >= filtered - 1) & _bit(known, _keyed(hashes[filtered], filtered))
            for k in lengths:
                take = text.follow >= k - 1
                if filtered:
                    for step in range(k - filtered + 1):
                        take[: max(len(good) - step, 0)] &= good[step:]
                sums[k].add(_keyed(hashes[k][take], k), text.document[take])
                if len(sums[k].keys) >= HELD:
                    yield from sums[k].rows()
                    sums[k] = _Sums()
        for held in sums.values():
            yield from held.rows()

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words per language, summed over a task."""
    totals: dict[str, int] = {}
    for batch in batches:
        for part in W.slices(batch, limit=SLICE_BYTES):
            counts = W.split(W.texts_of(part.column("text")), _SPACE).per_text.tolist()
            for lang, n in zip(part.column("lang").to_pylist(), counts):
                totals[lang] = totals.get(lang, 0) + n
    yield pa.record_batch({"lang": pa.array(list(totals), pa.string()), "n": pa.array(list(totals.values()), pa.int64())})


def _strings(text: Text, lang: list[str], at: np.ndarray, k: int) -> list[str]:
    """Language, line feed and the words joined by a blank, for phrases of k words."""
    words, out = text.words, []
    owner = np.searchsorted(words.first, at, side="right") - 1
    data = words.data.tobytes()
    starts, ends = words.starts.tolist(), words.ends.tolist()
    for i, t in zip(at.tolist(), owner.tolist()):
        body = b" ".join([data[starts[j] : ends[j]] for j in range(i, i + k)])
        out.append(f"{lang[t]}\n{body.decode()}")
    return out


def _collect(bitmap, marks) -> Callable:
    """Phrases whose bit is set, from the documents whose numbers mark them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, marked = bitmap.value, marks.value
        sums = {k: _Sums() for k in range(1, LONGEST + 1)}
        for part, text in _texts(batches):
            lang = part.column("lang").to_pylist()
            hashes = _hashed(text.symbols, range(1, LONGEST + 1))
            for k, held in sums.items():
                at = np.flatnonzero(text.follow >= k - 1)
                at = at[_bit(known, _keyed(hashes[k][at], k))]
                at = at[_bit(marked, _marked(_keyed(hashes[k][at], k), text.document[at]))]
                new = held.add(hashes[k][at], text.document[at])
                if len(new):
                    yield pa.record_batch({"phrase": pa.array(_strings(text, lang, at[new], k), pa.string())})
                if len(held.keys) >= HELD:
                    sums[k] = _Sums()

    return run


@dataclass
class Trie:
    """Double array over word codes; the code of a word is its place in ``symbols``, from 1."""

    symbols: np.ndarray
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray
    ids: np.ndarray

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.symbols, symbols), len(self.symbols) - 1)
        return np.where(self.symbols[at] == symbols, at + 1, 0)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none."""
        to = self.base[state] + code
        return np.where((code > 0) & (self.check[to] == state), to, -1)

    def count(self, text: Text) -> np.ndarray:
        """Number of positions that come by each state."""
        codes = self.codes(text.symbols)
        at = np.arange(len(codes))
        state = np.zeros(len(codes), dtype=np.int64)
        met = np.zeros(len(self.check), dtype=np.int64)
        for level in range(LONGEST):
            inside = text.follow[at] >= level
            at, state = at[inside], state[inside]
            state = self.step(state, codes[at + level])
            at, state = at[state >= 0], state[state >= 0]
            if not len(at):
                break
            met += np.bincount(state, minlength=len(met))
        return met


def build(ids: Sequence[int], phrases: Sequence[str]) -> Trie:
    """Trie of phrases, each a language, a line feed and words joined by blanks."""
    split = [p.rsplit("\n", 1) for p in phrases]
    words = sorted({(lang, w) for lang, body in split for w in body.split(" ")})
    body = [w.encode() for _, w in words]
    ends = np.cumsum([len(w) for w in body])
    hashes = W.range_hashes(np.frombuffer(b"".join(body), dtype=np.uint8), ends - [len(w) for w in body], ends)
    languages = _language_hashes(pa.array([lang for lang, _ in words], pa.string()))
    symbols = _symbols(hashes, languages)
    order = np.argsort(symbols)
    if (np.diff(symbols[order].view(np.int64)) == 0).any():
        raise ValueError("two frequent words share a 64-bit hash")
    code = dict(zip([words[i] for i in order], range(1, len(words) + 1)))

    paths = [[code[lang, w] for w in text.split(" ")] for lang, text in split]
    lengths = np.array([len(p) for p in paths])
    codes = np.zeros((len(paths), LONGEST), dtype=np.int64)
    codes[np.repeat(np.arange(len(paths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = np.concatenate(paths)
    del words, split, paths, code
    # in the order of their words, phrases with a common begin lie together
    rows = np.lexsort(codes.T[::-1])
    width = len(symbols) + 1
    size = 3 * int(lengths.sum()) + 2 * width
    base, check = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64)
    check[0] = size  # the root is nobody's child
    state = np.zeros(len(codes), dtype=np.int64)
    rng = np.random.default_rng(1)
    for level in range(LONGEST):
        rows = rows[lengths[rows] > level]
        if not len(rows):
            break
        parent, own = state[rows], codes[rows, level]
        heads = np.flatnonzero(np.concatenate([[True], (parent[1:] != parent[:-1]) | (own[1:] != own[:-1])]))
        parent, own, child = parent[heads], own[heads], np.empty(len(heads), dtype=np.int64)
        begin = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        end = np.append(begin[1:], len(heads))
        # many children first, while there is room
        for g in np.argsort(begin - end, kind="stable"):
            some = own[begin[g] : end[g]]
            for _ in range(32):
                b = 0 if not level else int(rng.integers(0, size - width))
                if (check[b + some] < 0).all():
                    break
            else:
                # room at the end, always free
                b = len(check)
                base, check = np.append(base, np.zeros(width, dtype=np.int64)), np.append(check, np.full(width, -1))
            base[parent[begin[g]]] = b
            check[b + some] = parent[begin[g]]
            child[begin[g] : end[g]] = b + some
        state[rows] = np.repeat(child, np.diff(np.append(heads, len(rows))))
    # steps from any base stay inside
    base, check = np.append(base, np.zeros(width, dtype=np.int64)), np.append(check, np.full(width, -1))
    return Trie(symbols[order], base, check, state, np.asarray(ids, dtype=np.int64))


def _counted(trie) -> Callable:
    """Counts of the phrases of a trie, in blocks by the place of the phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Trie = trie.value
        met = np.zeros(len(own.check), dtype=np.int64)
        for _, text in _texts(batches):
            met += own.count(text)
        counts = met[own.accept]
        blocks = [b for b in range(0, len(counts), BLOCK) if counts[b : b + BLOCK].any()]
        group = TaskContext.get().partitionId() % GROUPS
        yield pa.record_batch({
            "block": pa.array([b // BLOCK for b in blocks], pa.int32()), "part": pa.array([group] * len(blocks), pa.int32()),
            "counts": pa.array([counts[b : b + BLOCK].tobytes() for b in blocks], pa.binary()),
        })

    return run


_BLOCKS = "block int, part int, counts binary"


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, dtype=np.int64) for x in table.column("counts").to_pylist())
    return table.slice(0, 1).set_column(2, "counts", pa.array([total.tobytes()], pa.binary()))


def _named(trie) -> Callable:
    """Blocks of counts to rows of (id, a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = trie.value.ids
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                own = np.frombuffer(counts, dtype=np.int64)
                yield pa.record_batch({"id": pa.array(ids[block * BLOCK : block * BLOCK + len(own)]), "a": pa.array(own)})

    return run


def _bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """Bit map of some 63-bit keys (``key``); packed by tasks, put together on the driver."""
    place = f"(shiftright(key, {63 - bits}) + 1)"
    packs = rows.groupBy(F.expr(f"bitmap_bucket_number({place})").alias("pack")).agg(
        F.expr(f"bitmap_construct_agg(bitmap_bit_position({place}))").alias("bits")
    )
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in packs.toLocalIterator():
        out[(row["pack"] - 1) * 4096 : row["pack"] * 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, documents = batch.column("key").to_numpy().view(np.uint64), batch.column("document").to_numpy()
        yield pa.record_batch({"key": pa.array(_marked(keys, documents).view(np.int64))})


def _texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    )


def frequent(docs: DataFrame, least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(phrase, a) of all phrases of 1 to 5 words with a >= ``least``, and (lang, n), the words per language.

    A phrase is its language, a line feed and its words joined by blanks.
    """
    spark, texts = docs.sparkSession, _texts_of(docs)
    share = spark.sparkContext.broadcast

    def seen(lengths, filtered=0, bitmap=None):
        rows = texts.mapInArrow(_seen(lengths, filtered, bitmap), _COUNTED)
        return kept(rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("document").alias("document")).where(f"n >= {least}"), "seen")

    totals = kept(texts.mapInArrow(_totals, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")), "words")
    n = totals.agg(F.sum("n")).first()[0] or 0
    bits = min(max((SPARSE * n // least).bit_length(), LEAST_BITS), MOST_BITS)
    found = seen([1])
    for lengths, filtered in (([2], 1), ([3], 2), ([4, 5], 3)):
        bitmap = share(_bitmap(found.where(f"key & 7 = {filtered}"), bits))
        found = found.union(seen(lengths, filtered, bitmap))
        bitmap.destroy()
    known = share(_bitmap(found.select("key"), bits))
    marks = share(_bitmap(found.mapInArrow(_marks, "key long"), bits))
    candidates = kept(
        kept(texts.mapInArrow(_collect(known, marks), "phrase string").distinct(), "phrases").withColumn("id", F.monotonically_increasing_id()),
        "candidates",
    )
    known.destroy()
    marks.destroy()
    shards = -(-candidates.count() // shard)
    counts = empty(spark, "phrase string, a long")
    for s in range(shards):
        own = candidates.where(F.pmod(F.xxhash64("phrase"), F.lit(shards)) == s)
        ids, phrases = [], []
        for row in own.toLocalIterator():
            ids.append(row["id"])
            phrases.append(row["phrase"])
        if not ids:
            continue
        trie = share(build(ids, phrases))
        del ids, phrases
        blocks = texts.mapInArrow(_counted(trie), _BLOCKS).groupBy("block", "part").applyInArrow(_added, _BLOCKS)
        sums = blocks.groupBy("block").applyInArrow(_added, _BLOCKS).mapInArrow(_named(trie), "id long, a long").where(f"a >= {least}")
        counts = counts.union(own.join(kept(sums, "counts"), "id").select("phrase", "a"))
        trie.destroy()
    return counts, totals


def collocations(docs: DataFrame, least: int = LEAST, inside: int = 100, shard: int = SHARD) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate of 2 to 5 words.

    ``score`` is floor(1000 * a * n / (l * r)) at the cut where it is lowest.
    A candidate goes when a longer one holds it with at least ``inside``
    percent of its occurrences. It is enough to look one word further: what
    holds it with more words between also holds one of those.
    """
    counts, totals = frequent(docs, least, shard)
    counts = kept(counts, "frequent")
    parts = F.split(F.substring_index("phrase", "\n", -1), " ")
    named = counts.withColumn("words", parts).withColumn(
        "lang", F.expr("left(phrase, length(phrase) - length(substring_index(phrase, '\\n', -1)) - 1)")
    )
    phrases = named.where("size(words) > 1")

    def joined(lang, words):
        return F.concat(lang, F.lit("\n"), F.array_join(words, " "))

    cuts = phrases.select(
        "phrase", "lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut")
    ).select(
        "phrase", "lang", "words", "a", "cut", joined("lang", F.slice("words", F.lit(1), F.col("cut"))).alias("head"),
        joined("lang", F.slice("words", F.col("cut") + 1, F.size("words"))).alias("rest"),
    )
    heads = counts.select(F.col("phrase").alias("head"), F.col("a").alias("l"))
    rests = counts.select(F.col("phrase").alias("rest"), F.col("a").alias("r"))
    wide = "decimal(38, 0)"
    score = F.expr(f"(CAST(1000 AS {wide}) * a * n) DIV (CAST(l AS {wide}) * r)")
    scored = cuts.join(heads, "head").join(rests, "rest").join(totals, "lang").withColumn("score", score)
    lowest = scored.groupBy("phrase", "lang", "words", "a", "n").agg(
        F.array_min(F.collect_list(F.struct("score", "cut", "l", "r"))).alias("low")
    )
    last = F.size("words")
    around = phrases.where("size(words) > 2").select(
        "a", F.explode(F.array(
            joined("lang", F.slice("words", F.lit(1), last - 1)), joined("lang", F.slice("words", F.lit(2), last - 1))
        )).alias("phrase"),
    ).groupBy("phrase").agg(F.max("a").alias("most"))
    return (
        lowest.join(around, "phrase", "left").where(f"most IS NULL OR 100 * most < {inside} * a")
        .select("lang", F.array_join("words", " ").alias("phrase"), "a", "low.l", "low.r", "n", "low.score")
    )


def ranked(docs: DataFrame, top: int = TOP, least: int = LEAST, inside: int = 100, shard: int = SHARD) -> DataFrame:
    """The first ``top`` phrases of each language by score, count and phrase."""
    rows = kept(collocations(docs, least, inside, shard), "collocations")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    return first_n(rows, ["lang"], order, top, "rank").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
