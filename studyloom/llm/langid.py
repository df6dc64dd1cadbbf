"""Language of whole texts by a linear-chain conditional random field over words.

Every word of a text gets a label, so a text may switch languages. A word votes
by features of its bytes: affixes (the first and last one to four bytes),
n-grams (every two, three and four bytes in a row, across the word's ends), the
word itself (lexicon) and its shape. Weights are looked up in a hashed table.
Transitions between neighbouring labels are learned together with the weights,
by gradient steps on the exact likelihood, from texts joined to switch
languages on the way. A text's language is the label with the largest sum of
word probabilities from forward-backward; the score is its mean.

Chains are cut into blocks of ``BLOCK`` words: all blocks of a slice walk their
words together, first for the transfer matrix of the block, then, once the
blocks of each text are joined, with the message that enters it. That is the
exact result of one walk over the whole text.

Training reads a bounded sample: up to ``SAMPLE`` texts of each language, those
with the smallest hash, of each ``EXCERPT`` words at most from a place drawn by
hash. Prediction reads every word.

Rows: a text that is null or without letters is ``und`` with score 0, as is
every text if there was nothing to learn from. Only words with letters vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W

SAMPLE = 300
EXCERPT = 120
EPOCHS = 4
RATE = 0.3
TABLE_BITS = 17
BLOCK = 64
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:256] = True


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (2^TABLE_BITS, labels)
    transitions: np.ndarray  # (labels, labels), from row to column
    start: np.ndarray


def _slots(x: np.ndarray, kind: int) -> np.ndarray:
    """Place of each feature value in the weight table."""
    x = (x + np.uint64(kind)) * np.uint64(W.BASE)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - TABLE_BITS)).astype(np.int32)


GRAMS = (2, 3, 4)


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """Slots of the 2-, 3- and 4-grams that start at each byte (white space reads as the word's end)."""
    x = np.where(W.IS_SPACE[data], np.uint8(32), W.LOWER[data]).astype(np.uint64)
    x = np.concatenate([x, np.full(3, 32, dtype=np.uint64)])
    n, gram, out = len(data), x[: len(data)], []
    for k in range(1, max(GRAMS)):
        gram = gram << np.uint64(8) | x[k : n + k]
        out.append(_slots(gram, k))
    return out


def _spans(words: W.Words, k: int) -> np.ndarray:
    """End of the k-grams of each word: they reach no further than the white space after it."""
    return np.maximum(words.ends - k + 2, words.starts)


def _word_features(words: W.Words) -> np.ndarray:
    """(words, features) slots of affixes, lexicon and shape."""
    low = W.LOWER[words.data]
    size = words.ends - words.starts
    columns = [_slots(W.range_hashes(low, words.starts, words.ends), 20)]
    head, tail = np.zeros((2, len(size)), dtype=np.uint64)
    for k in range(4):
        there = size > k
        head = np.where(there, head << np.uint64(8) | low[np.minimum(words.starts + k, words.ends - 1)], head)
        tail = np.where(there, tail << np.uint64(8) | low[np.maximum(words.ends - 1 - k, words.starts)], tail)
        columns += [_slots(head, 30 + k), _slots(tail, 40 + k)]
    capital = (words.data[words.starts] >= 65) & (words.data[words.starts] <= 90)
    shape = np.minimum(size, 15).astype(np.uint64) * np.uint64(2) + capital.astype(np.uint64)
    columns.append(_slots(shape, 50))
    return np.stack(columns, axis=1)


def _features(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """All feature slots of all words, and the word of each."""
    own = _word_features(words)
    slots, owner = [own.reshape(-1)], [np.repeat(np.arange(len(own)), own.shape[1])]
    for k, grams in zip(GRAMS, _grams(words.data)):
        n = _spans(words, k) - words.starts
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(words.starts, n)
        slots.append(grams[at])
        owner.append(np.repeat(np.arange(len(n)), n))
    return np.concatenate(slots), np.concatenate(owner)


def emissions(words: W.Words, weights: np.ndarray) -> np.ndarray:
    """(words, labels) sums of the weights of each word's features."""
    own, grams = _word_features(words), _grams(words.data)
    out = np.zeros((len(words.starts), weights.shape[1]), dtype=np.float32)
    sums = np.zeros(len(words.data) + 1)
    for label in range(weights.shape[1]):
        column = np.ascontiguousarray(weights[:, label])
        total = column[own].sum(axis=1, dtype=np.float64)
        for k, g in zip(GRAMS, grams):
            np.cumsum(column[g], out=sums[1:])
            total += sums[_spans(words, k)] - sums[words.starts]
        out[:, label] = total
    return out


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probability of each label for each word of some chains, by forward-backward over blocks.

    ``scores`` are the emissions of all words, ``first`` the first word of each chain.
    """
    n, k = scores.shape
    if not n:
        return np.zeros((0, k), dtype=np.float32)
    size = np.diff(first)
    blocks = -(-size // BLOCK)
    chain = np.repeat(np.arange(len(size)), blocks)
    head = np.concatenate([[0], np.cumsum(blocks)])
    begin = first[chain] + (np.arange(len(chain)) - head[chain]) * BLOCK
    # longest blocks first, so those that still have a word are a prefix
    length = np.minimum(BLOCK, first[chain + 1] - begin)
    order = np.argsort(-length, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    live = np.searchsorted(-length[order], -np.arange(1, BLOCK + 1), side="right")
    opens = np.zeros(len(chain), dtype=bool)
    opens[head[:-1][size > 0]] = True
    opens = opens[order]
    move, opening = np.exp(transitions).astype(np.float32), np.exp(start).astype(np.float32)

    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)
    emit = np.maximum(emit, np.float32(1e-30))
    grid = np.ones((BLOCK, len(chain), k), dtype=np.float32)
    place = np.arange(n) - np.repeat(begin, length)
    block = rank[np.repeat(np.arange(len(chain)), length)]
    grid[place, block] = emit

    def step(rows: np.ndarray, t: int) -> np.ndarray:
        """One move of messages (blocks, ..., labels); the first word of a chain has its own."""
        out = rows.reshape(-1, k) @ move
        out = out.reshape(rows.shape)
        if t == 0:
            out[opens] = rows[opens].sum(axis=-1, keepdims=True) * opening
        return out

    # transfer matrix of each block: product over its words of move and emission
    transfer = np.tile(np.eye(k, dtype=np.float32), (len(chain), 1, 1))
    if blocks.max() > 1:
        for t in range(BLOCK):
            m = live[t]
            own = step(transfer[:m], t) * grid[t, :m, None, :]
            transfer[:m] = own / own.max(axis=(1, 2), keepdims=True)

    # messages into each block, forwards from the start and backwards from the end
    enter, leave = np.full((2, len(chain), k), 1 / k, dtype=np.float32)
    for j in range(1, int(blocks.max())):
        ahead = head[:-1][blocks > j] + j
        here, there = rank[ahead - 1], rank[ahead]
        message = np.einsum("bi,bij->bj", enter[here], transfer[here])
        enter[there] = message / message.sum(axis=1, keepdims=True)
        ahead = head[1:][blocks > j] - j
        here, there = rank[ahead - 1], rank[ahead]
        message = np.einsum("bij,bj->bi", transfer[there], leave[there])
        leave[here] = message / message.sum(axis=1, keepdims=True)

    # walk every block with the messages that enter it
    message = enter
    result = np.empty_like(grid)
    for t in range(BLOCK):
        m = live[t]
        own = step(message[:m], t) * grid[t, :m]
        own /= own.sum(axis=1, keepdims=True)
        result[t, :m] = message[:m] = own
    message = leave
    for t in range(BLOCK - 1, -1, -1):
        m = live[t]
        own = result[t, :m] * message[:m]
        result[t, :m] = own / own.sum(axis=1, keepdims=True)
        back = (message[:m] * grid[t, :m]) @ move.T
        message[:m] = back / back.sum(axis=1, keepdims=True)
    return result[place, block]


def train(texts: list[str], languages: list[str], seed: int = 1) -> Model:
    """Fit weights and transitions on texts joined into chains that switch languages."""
    labels = sorted(set(languages))
    k = len(labels)
    number = {x: i for i, x in enumerate(labels)}
    words = W.split(W.texts_of(pa.array(texts, pa.string())))
    slots, owner = _features(words)
    by_word = np.argsort(owner, kind="stable")
    slots = slots[by_word]
    feature = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words.starts)))])
    truth = np.repeat([number[x] for x in languages], words.per_text)
    # runs of up to a third of an excerpt, shuffled, three runs to a chain
    third = EXCERPT // 3
    runs = [(a, min(a + third, end)) for first, end in zip(words.first, words.first[1:]) for a in range(first, end, third)]
    random = np.random.default_rng(seed)
    model = Model(labels, np.zeros((1 << TABLE_BITS, k), dtype=np.float32), np.zeros((k, k)), np.zeros(k))
    moved, seen = np.full_like(model.weights, 1e-6), 1e-6
    for _ in range(EPOCHS if k > 1 else 0):
        mixed = random.permutation(len(runs))
        for low in range(0, len(mixed), 192):
            part = [runs[i] for i in mixed[low : low + 192]]
            chains = [part[i : i + 3] for i in range(0, len(part), 3)]
            at = np.concatenate([np.arange(a, b) for c in chains for a, b in c])
            first = np.concatenate([[0], np.cumsum([sum(b - a for a, b in c) for c in chains])])
            n = np.diff(feature)[at]
            places = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(feature[at], n)
            use, word = slots[places], np.repeat(np.arange(len(at)), n)
            scores = np.add.reduceat(model.weights[use], np.cumsum(n) - n, axis=0)
            own, both = _pair_marginals(scores, first, model)
            goal = np.eye(k, dtype=np.float32)[truth[at]]
            slope = np.zeros_like(model.weights)
            np.add.at(slope, use, (goal - own)[word] / len(chains))
            moved += slope**2
            model.weights += RATE * slope / np.sqrt(moved)
            last = np.zeros(len(at), dtype=bool)
            last[first[1:] - 1] = True
            pairs = np.flatnonzero(~last)
            target = np.zeros((k, k))
            np.add.at(target, (truth[at][pairs], truth[at][pairs + 1]), 1)
            change = (target - both) / len(pairs)
            seen += (change**2).sum()
            model.transitions += RATE * change / np.sqrt(seen)
            model.start += RATE * (goal - own)[first[:-1]].mean(axis=0) * 0.1
    return model


def _pair_marginals(scores: np.ndarray, first: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals, and the expected number of moves between labels over all chains."""
    k = scores.shape[1]
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    move = np.exp(model.transitions)
    alpha = np.empty((len(scores), k))
    beta = np.ones((len(scores), k))
    steps = [int((size > t).sum()) for t in range(int(size[0]))]
    for t, m in enumerate(steps):
        own = (np.exp(model.start) if t == 0 else alpha[begin[:m] + t - 1] @ move) * emit[begin[:m] + t]
        alpha[begin[:m] + t] = own / own.sum(axis=1, keepdims=True)
    both = np.zeros((k, k))
    for t in range(len(steps) - 1, 0, -1):
        at = begin[: steps[t]] + t
        later = emit[at] * beta[at]
        pair = alpha[at - 1][:, :, None] * move * later[:, None, :]
        both += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = later @ move.T
        beta[at - 1] = back / back.sum(axis=1, keepdims=True)
    own = alpha * beta
    return own / own.sum(axis=1, keepdims=True), both


def word_labels(text: pa.Array, model: Model) -> tuple[W.Words, np.ndarray]:
    """Words of some texts and their label probabilities."""
    words = W.split(text)
    if not len(model.labels):
        return words, np.zeros((len(words.starts), 0), dtype=np.float32)
    return words, marginals(emissions(words, model.weights), words.first, model.transitions, model.start)


def classify(text: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    if not len(model.labels):
        return np.full(len(text), UNKNOWN, dtype=object), np.zeros(len(text))
    words, own = word_labels(text, model)
    letters = np.concatenate([[0], np.cumsum(_LETTER[words.data])])
    votes = own * (letters[words.ends] > letters[words.starts])[:, None]
    sums = np.concatenate([np.zeros((1, votes.shape[1])), np.cumsum(votes, axis=0, dtype=np.float64)])
    sums = np.maximum(sums[words.first[1:]] - sums[words.first[:-1]], 0)
    best, total = sums.argmax(axis=1), sums.sum(axis=1)
    latin = np.concatenate([[0], np.cumsum(_LETTER[words.data] & (words.data < 128))])
    known = latin[words.offsets[1:]] > latin[words.offsets[:-1]]
    for i in np.flatnonzero(~known & (total > 0)):  # bytes beyond ASCII alone: are they letters?
        known[i] = any(c.isalpha() for c in text[int(i)].as_py())
    known &= total > 0
    share = np.where(known, sums[np.arange(len(sums)), best] / np.maximum(total, 1e-12), 0.0)
    names = np.array([*model.labels, UNKNOWN], dtype=object)
    return names[np.where(known, best, len(model.labels))], np.clip(share, 0.0, 1.0)


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                names, share = classify(W.texts_of(part.column("text")), shared.value)
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(share),
                })

    return run


def _accepted(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                names, share = classify(W.texts_of(part.column("text")), shared.value)
                yield part.filter(pa.array((names != UNKNOWN) & (share >= least)))

    return run


def sample(docs: DataFrame) -> DataFrame:
    """A bounded number of excerpts of different texts for each language, drawn by the hash of the text.

    Texts with a small hash are picked where they lie, a few times as many as
    are wanted, so that the last choice sees a bounded number of them. Copies
    count once.
    """
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    different = docs.select("lang", F.xxhash64("text").alias("h")).distinct()
    counts = different.groupBy("lang").count().collect()  # a row per language, as in the model
    if not counts:
        return docs.limit(0)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(4.0 * SAMPLE / r["count"], 1.0))])
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    docs = docs.where((drawn < share[F.col("lang")]) | (share[F.col("lang")] >= 1.0))
    pieces = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    return (
        docs.distinct().withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= SAMPLE).select("lang", "text", pieces.alias("w"))
        .select("lang", F.array_join(F.slice("w", (F.pmod(F.xxhash64("text"), F.greatest(F.size("w") - EXCERPT, F.lit(1))) + 1).cast("int"), EXCERPT), " ").alias("text"))
        .where("text <> ''")
    )


def fit(docs: DataFrame) -> Model:
    """Learn from text and lang of ``docs``; the sample is bounded, so it may come to the driver."""
    rows = sample(docs).orderBy("lang", "text").collect()
    if not rows:
        return Model([], np.zeros((1 << TABLE_BITS, 0), dtype=np.float32), np.zeros((0, 0)), np.zeros(0))
    return train([r.text for r in rows], [r.lang for r in rows])


def _model(docs: DataFrame, learn_from: Column):
    own = docs.where(learn_from).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # TABLE_BITS bounds the size of the model
    return docs.sparkSession.sparkContext.broadcast(fit(own))


def predict(docs: DataFrame, learn_from: Column) -> DataFrame:
    """doc_id, lang_pred and score of every row; learns from the rows where the condition holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predicted(_model(docs, learn_from)), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, learn_from: Column, least: float) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text is in some language with a score of ``least`` or more."""
    # names of no meaning on the way, as those of the input may hold anything
    plain = docs.toDF(*["text" if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)])
    return plain.mapInArrow(_accepted(_model(docs, learn_from), least), plain.schema).toDF(*docs.columns)
