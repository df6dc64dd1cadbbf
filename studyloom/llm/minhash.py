"""Near-duplicate documents by HyperMinHash sketches and exact confirmation.

A document is the set of its distinct 5-word shingles. Each shingle hash falls
into one of ``REGISTERS`` buckets; a bucket keeps the leading-zero count of its
smallest hash and the ten bits after the leading one (16 bits together). Empty
buckets of short texts take the value of a filled bucket found by a probe order
that is the same for all documents. Bands of four registers find candidates, a
collision-corrected estimate drops the hopeless ones, and every remaining pair
is confirmed on the full shingle sets.

No group is expanded into pairs: equal sets become one class first; each member
of a band bucket meets its pivot, and those the pivot's component leaves out
meet a second one; only members of buckets that still hold several components
are compared across them, on sketches, in blocks of bounded size. Of two
components only the most alike pairs are confirmed, more of them only where
those fail.

Rows: null text, empty text and text without words have no shingles and stay
alone. A row without id stays alone with a null component. Rows that share an
id count as one document, linked by whatever either of them holds. Every input
row gives one output row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import components, kept, sieved

SHINGLE_WORDS = 5
REGISTERS = 128
BAND_ROWS = 4
BAND_BITS = 6
MANTISSA_BITS = 10
PROBES = 64
PIVOTS = 2
ERRORS = 4.5
BLOCK = 256
SMALL = 256
#: Pairs of two components that are confirmed at first; more of them after each failure.
CANDIDATES = 64
FURTHER = 16

_SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, sketch array<long>, shingles array<int>"


def _rule(n: int, m: int, salt: int) -> np.ndarray:
    """n x m pseudo-random words, the same everywhere."""
    cells = np.arange(n * m, dtype=np.uint64) + np.uint64(1 + (salt << 32))
    return W.mix(cells * np.uint64(W.BASE)).reshape(n, m)


def registers(hashes: np.ndarray, document: np.ndarray, n_documents: int) -> np.ndarray:
    """(documents, REGISTERS) codes, larger for a smaller hash, 0 where empty.

    ``hashes`` are ascending within each document.
    """
    out = np.zeros((n_documents, REGISTERS), dtype=np.uint16)
    if not len(hashes):
        return out
    bucket = ((hashes >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    rest = W.mix(hashes + np.uint64(W.BASE)) >> np.uint64(11)
    fraction, exponent = np.frexp(rest.astype(np.float64))
    zeros = 53 - exponent
    mantissa = np.maximum((fraction * (2 << MANTISSA_BITS)).astype(np.int64) - (1 << MANTISSA_BITS), 0)
    code = (zeros << MANTISSA_BITS) + ((1 << MANTISSA_BITS) - mantissa)
    cell = document * REGISTERS + bucket.astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    out.reshape(-1)[cell[heads]] = np.maximum.reduceat(code, heads)
    return out


def fill_empty(codes: np.ndarray) -> np.ndarray:
    """Give empty registers the value of a filled one, by probes that do not depend on the document."""
    filled = codes > 0
    row, column = np.nonzero(~filled & filled.any(axis=1)[:, None])
    if not len(row):
        return codes
    out = codes.copy()
    probes = (_rule(REGISTERS, PROBES, 1) % np.uint64(REGISTERS)).astype(np.int64)
    for t in range(PROBES):
        source = probes[column, t]
        hit = filled[row, source]
        out[row[hit], column[hit]] = codes[row[hit], source[hit]]
        row, column = row[~hit], column[~hit]
    if len(row):
        # what 64 probes missed: the filled register that comes first in a fixed order per column
        order = np.argsort(_rule(REGISTERS, REGISTERS, 2), axis=1)
        for low in range(0, len(row), 4096):
            r, c = row[low : low + 4096], column[low : low + 4096]
            choice = order[c]
            source = choice[np.arange(len(r)), filled[r[:, None], choice].argmax(axis=1)]
            out[r, c] = codes[r, source]
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch):
            words = W.split(W.texts_of(part.column("text")))
            runs, first = W.shingles(W.hashes(words, lower=True), words.first, SHINGLE_WORDS)
            sets = [np.unique(runs[a:b]) for a, b in zip(first, first[1:])]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            flat = np.concatenate(sets) if sets else runs
            document = np.repeat(np.arange(len(sets)), sizes)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            codes = fill_empty(registers(flat, document, len(sets)))
            second = W.mix(flat ^ np.uint64(W.BASE))
            sums, more = np.zeros((2, len(flat) + 1), dtype=np.uint64)
            np.cumsum(flat, out=sums[1:])
            np.cumsum(second, out=more[1:])
            values = pa.array(codes.view(np.uint64).astype(np.int64).reshape(-1))
            per = REGISTERS // 4
            short = sizes <= SMALL
            few = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(short, sizes, 0))]).astype(np.int32)),
                pa.array((flat[np.repeat(short, sizes)] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
            )
            yield pa.record_batch({
                "doc_id": part.column("doc_id"),
                "n_shingles": pa.array(sizes),
                "f1": pa.array((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)),
                "f2": pa.array((more[bounds[1:]] - more[bounds[:-1]]).view(np.int64)),
                "sketch": pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * per + 1, per, dtype=np.int32)), values),
                "shingles": few,
            })


def _codes(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).view(np.uint16).reshape(len(column), REGISTERS)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the number of equal registers, less the chance collisions.

    The expected number of collisions of two disjoint sets is that of the
    HyperMinHash paper, for sets of n and m elements.
    """
    ratio = np.minimum(n, m) / np.maximum(np.maximum(n, m), 1)
    chance = 0.169919487159739 * REGISTERS / (1 << MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    return np.clip((equal - chance) / (REGISTERS - chance), 0, 1)


def hopeful(equal: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose sizes allow a link and whose estimate is above the threshold less ``ERRORS`` standard errors."""
    j = percent / 100
    effective = np.clip(np.minimum(n, m), 1, REGISTERS)
    near = estimate(equal, n, m) >= j - ERRORS * np.sqrt(j * (1 - j) / effective)
    return near & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def _estimated(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            equal = (_codes(batch.column("sketch_a")) == _codes(batch.column("sketch_b"))).sum(axis=1)
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            keep = pa.array(hopeful(equal, n, m, percent))
            yield batch.select(["a", "b"]).filter(keep)

    return run


def _set_list(column: pa.Array) -> list[np.ndarray]:
    sets: list[np.ndarray] = []
    for part in W.slices(pa.record_batch({"text": W.texts_of(column)})):
        words = W.split(W.texts_of(part.column("text")))
        runs, first = W.shingles(W.hashes(words, lower=True), words.first, SHINGLE_WORDS)
        sets += [np.unique(runs[a:b]) for a, b in zip(first, first[1:])]
    return sets


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_set_list(batch.column("text_a")), _set_list(batch.column("text_b"))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return run


def _alike(x: frozenset, y: frozenset, n: int, m: int, percent: int) -> bool:
    both = len(x & y)
    return 100 * both >= percent * (n + m - both)


def _across_components(percent: int, low: int, high: int):
    """Pairs of one block pair of a bucket that lie in different components and look alike.

    Small sets come along whole (shortened hashes), as the estimate says little
    about them. Of the pairs of the same two components (``component``) those
    numbered ``low`` to ``high`` are given out, by likeness and ids, unless the
    components hold together by now (``now``).
    """

    def run(table: pa.Table) -> pa.Table:
        codes = _codes(table.column("sketch").combine_chunks())
        bands, band = codes.view(np.uint64), table.column("key")[0].as_py() & ((1 << BAND_BITS) - 1)
        names = ("id", "n_shingles", "component", "now", "block")
        id_, n, component, now, block = (table.column(c).to_numpy() for c in names)
        sets = table.column("shingles").to_pylist()
        sets = [None if s is None else frozenset(s) for s in sets]
        first = block == block.min()
        left, right = np.flatnonzero(first), np.flatnonzero(~first) if not first.all() else np.flatnonzero(first)
        found: list[np.ndarray] = []
        for i in left:
            equal = (codes[right] == codes[i]).sum(axis=1)
            good = hopeful(equal, n[right], n[i], percent) & (component[right] != component[i])
            if first.all():
                good &= right > i
            hit, equal = right[good], equal[good]
            # a pair that shares several bands is found in the first of them
            own_band = (bands[hit] == bands[i]).argmax(axis=1) == band
            hit, equal = hit[own_band], equal[own_band]
            if n[i] <= SMALL:
                own = sets[i]
                alike = np.array([n[j] > SMALL or _alike(own, sets[j], n[i], n[j], percent) for j in hit], dtype=bool)
                hit, equal = hit[alike], equal[alike]
            found.append(np.stack([np.full(len(hit), i), hit, equal], axis=1))
        x, y, equal = np.concatenate(found).T if found else np.zeros((3, 0), dtype=np.int64)
        a, b = np.minimum(id_[x], id_[y]), np.maximum(id_[x], id_[y])
        p, q = np.minimum(component[x], component[y]), np.maximum(component[x], component[y])
        order = np.lexsort((b, a, -equal, q, p))
        x, y, a, b, p, q = (v[order] for v in (x, y, a, b, p, q))
        heads = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])[: len(p)])
        place = np.arange(len(p)) - np.repeat(heads, np.diff(np.append(heads, len(p))))
        give = (place >= low) & (place < high) & (now[x] != now[y])
        return pa.table({"a": pa.array(a[give]), "b": pa.array(b[give]), "more": pa.array(place[give] == high - 1)})

    return run


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct (doc_id, text) of the documents in ``ids`` (doc_id, repeats allowed), written once."""
    # the ids grow with the corpus: the same join at every size
    texts = sieved(docs.select("doc_id", "text"), "doc_id", ids).join(ids.distinct().hint("shuffle_merge"), "doc_id")
    return kept(texts.dropDuplicates(["doc_id", "text"]), "texts")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are alike enough."""
    texts = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return kept(
        pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
        .mapInArrow(_confirmed(percent), "a long, b long"),
        "links",
    )


def _linked(pairs: DataFrame, heads: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches and then whose full sets are alike enough."""
    a = heads.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"))
    b = heads.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b"))
    likely = kept(pairs, "pairs").join(a, "a").join(b, "b").mapInArrow(_estimated(percent), "a long, b long")
    return confirm(kept(likely.distinct(), "likely"), docs, percent)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Two documents are linked when 100 * common shingles >= ``percent`` * all
    shingles of both; components close that relation, and the smallest doc_id
    names a component.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = kept(docs.mapInArrow(_sketch, _SKETCH), "sketches")
    real = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")

    # equal sets are one class, named by the smallest id
    content = ["n_shingles", "f1", "f2"]
    classes = kept(real.groupBy(*content).agg(F.min("doc_id").alias("id")), "classes")
    members = kept(real.select("doc_id", *content).join(classes, content).select("doc_id", "id"), "members")
    heads = kept(
        real.join(classes.select(F.col("id").alias("doc_id"), *content), ["doc_id", *content])
        # the columns of the join: its rows stay where they are
        .dropDuplicates(["doc_id", *content]).select(F.col("doc_id").alias("id"), "n_shingles", "sketch"),
        "heads",
    )

    # ids of several contents, and their classes, hold together
    links = members.where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).join(
        members.groupBy(F.col("doc_id").alias("a")).agg(F.countDistinct("id").alias("n")).where("n > 1").select("a"), "a"
    )

    # members of each band bucket against its pivot, the smallest id; then those
    # that the pivot's component leaves out against a pivot of their own
    bands = heads.select("id", F.posexplode("sketch").alias("band", "key")).select(
        "id", F.shiftleft(F.xxhash64("key"), BAND_BITS).bitwiseOR(F.col("band").cast("long")).alias("key")
    )
    buckets, open_, groups, texts = None, bands, None, docs
    for _ in range(PIVOTS):
        shared = open_.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).where("pivot <> top").drop("top")
        shared = kept(shared, "pivots")
        met = kept(sieved(open_, "key", shared.select("key")).join(shared, "key"), "met")
        if buckets is None:
            # whatever is compared later is in a bucket of several: no other text or sketch is moved
            buckets, ids = met, kept(met.select("id").distinct(), "ids")
            texts = texts_of(docs, ids.withColumnRenamed("id", "doc_id"))
            heads = kept(sieved(heads, "id", ids), "heads")
        pairs = met.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
        links = links.union(_linked(pairs, heads, texts, percent))
        groups = components(links)
        own = met.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
        ahead = groups.select(F.col("id").alias("pivot"), F.col("component").alias("ahead"))
        open_ = kept(
            own.join(ahead, "pivot", "left").where("component <> coalesce(ahead, pivot)").select("id", "key"), "open"
        )

    # buckets that still hold several components: everyone across them, in blocks, on sketches
    named = buckets.join(groups, "id", "left").select("key", "id", "pivot", F.coalesce("component", "id").alias("component"))
    named = kept(named, "named")
    mixed = kept(
        named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"))
        .where("x <> y").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")),
        "mixed",
    )
    if mixed.limit(1).count():
        members_left = kept(named.where("id <> pivot").join(mixed, "key"), "rest")
        ids = kept(members_left.select(F.col("id").alias("doc_id")).distinct(), "ids")
        small = sieved(rows.where(f"n_shingles <= {SMALL}"), "doc_id", ids).join(ids, "doc_id").select(
            F.col("doc_id").alias("id"), "n_shingles", "shingles"
        ).dropDuplicates(["id", "n_shingles"])
        rest = members_left.join(heads.join(kept(small, "small"), ["id", "n_shingles"], "left"), "id")
        low, high = 0, CANDIDATES
        while True:
            now = groups.select("id", F.col("component").alias("now"))
            blocks = (
                rest.join(now, "id", "left").withColumn("now", F.coalesce("now", "id"))
                .withColumn("block", F.expr("pmod(xxhash64(id, key), blocks)").cast("int"))
                .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
                .select(
                    "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                    "id", "n_shingles", "component", "now", "block", "sketch", "shingles",
                )
            )
            found = blocks.groupBy("key", "low", "high").applyInArrow(_across_components(percent, low, high), "a long, b long, more boolean")
            found = kept(found, "across")
            if not found.limit(1).count():
                break
            links = links.union(confirm(kept(found.select("a", "b").distinct(), "pairs"), texts, percent))
            groups = components(links)
            if not found.where("more").limit(1).count():
                break
            low, high = high, FURTHER * high
    groups = groups.withColumnRenamed("id", "doc_id")
    named_members = (
        members.groupBy("doc_id").agg(F.min("id").alias("id"))
        .join(groups.select(F.col("doc_id").alias("id"), "component"), "id", "left")
        .select("doc_id", F.coalesce("component", "id").alias("component"))
    )
    return rows.select("doc_id", "n_shingles").join(named_members, "doc_id", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
