"""Document fingerprints by one-permutation MinHash, with built-in functions only.

The hashes of a text's 5-word shingles are dealt once to ``BINS`` bins by their
high bits; a bin keeps its smallest hash. An empty bin takes the value of a
filled one by optimal densification: a probe order that depends on the bin
alone, so two texts copy from the same bin wherever both have it filled. The
fingerprint is the ``BITS`` low bits of every bin (mixed with its number), one
hexadecimal digit each.
Likeness counts equal digits and takes off what chance alone makes equal.

Words are runs of characters other than blank and the controls 9 to 13; a text
with fewer words has one shingle. A text without words has the empty
fingerprint, which is like (1.0) other empty ones and unlike (0.0) all else.
Null text is empty.

The next document is the one with the next smaller doc_id, after the last the
first. It is found without ordering all documents in one task: ids are cut into
ranges by counts, of at most two times ``RANGE`` documents unless more share an
id, and each range also gets the first document of the range below. Rows that share an id follow one another in the
order of their texts. Rows without id have no next document, which reads as an
empty text.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.operators.staging import hold

from .tables import kept

SHINGLE_WORDS = 5
BINS = 128
BIN_BITS = 7
BITS = 4
PROBES = 16
RANGE = 1024
GROUP = 4096

_SPACE = r"[\x20\x09-\x0D]+"


def _bin(x: Column) -> Column:
    """Bin of a hash, ascending with it."""
    return (F.shiftright(x, 64 - BIN_BITS) + BINS // 2).cast("int")


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the fingerprint of a text column, step by step as rows cannot afford repeats."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), _SPACE), lambda w: w != "")
    df = hold(df, "_words", words)
    runs = F.when(F.size("_words") == 0, F.array().cast("array<long>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("_words") - (SHINGLE_WORDS - 1), F.lit(1))),
            lambda i: F.xxhash64(F.slice("_words", i, SHINGLE_WORDS)),
        )
    )
    df = hold(df.withColumn("_hashes", F.sort_array(runs)).drop("_words"), "_hashes", F.col("_hashes"))
    # ascending hashes: the first of each bin is its smallest
    first = F.filter("_hashes", lambda x, i: (i == 0) | (_bin(x) != _bin(F.get("_hashes", i - 1))))
    df = hold(df, "_least", first).drop("_hashes")
    df = hold(df, "_bins", F.transform("_least", _bin))
    at = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: F.get("_least", (F.array_position("_bins", k) - 1).cast("int")))
    df = hold(df, "_row", F.when(F.size("_bins") == BINS, F.col("_least")).otherwise(at))

    def filled(value: Column, k: Column) -> Column:
        probes = [F.get("_row", F.pmod(F.xxhash64(k, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
        # what the probes miss: the filled bin that comes first in an order drawn for this bin
        rest = F.array_min(F.transform("_least", lambda x: F.struct(F.xxhash64(k, F.lit(PROBES), _bin(x)).alias("o"), x.alias("x"))))["x"]
        return F.coalesce(value, *probes, rest)

    # low bits of the value mixed with the bin, or copies of one value would collide together
    digits = F.transform(
        F.transform("_row", lambda value, k: F.xxhash64(filled(value, k), k)),
        lambda x: F.substring(F.lit("0123456789abcdef"), (x.bitwiseAND(F.lit(2**BITS - 1)) + 1).cast("int"), 1),
    )
    df = hold(df, out, F.when(F.size("_least") == 0, "").otherwise(F.array_join(digits, "")))
    return df.drop("_least", "_bins", "_row")


def likeness(a: str, b: str) -> Column:
    """Estimated share of common shingles of two fingerprints, 0 to 1."""
    equal = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substring(F.col(a), i, F.lit(1)) == F.substring(F.col(b), i, F.lit(1))))
    chance = 1 / 2**BITS
    estimate = F.greatest((equal / BINS - chance) / (1 - chance), F.lit(0.0))
    return F.when(F.col(a) == F.col(b), 1.0).when((F.col(a) == "") | (F.col(b) == ""), 0.0).otherwise(estimate)


def _below(ranges: DataFrame) -> DataFrame:
    """(r, above): for each range the next range up that holds documents; above the last comes the first."""
    groups = max(-(-ranges.count() // GROUP), 1)
    grouped = kept(ranges.repartitionByRange(groups, "r").withColumn("g", F.spark_partition_id()), "groups")
    up = F.lead("r").over(Window.partitionBy("g").orderBy("r"))
    # one row per GROUP ranges, that is for some millions of documents
    groups = grouped.groupBy("g").agg(F.min("r").alias("low"))
    groups = groups.select("g", F.lead("low").over(Window.orderBy("g")).alias("next"))
    first = grouped.agg(F.min("r")).first()[0]
    return grouped.withColumn("up", up).join(groups, "g").select("r", F.coalesce("up", "next", F.lit(first)).alias("above"))


def _range(low: str, width: str) -> str:
    """First id of a document's range; in decimals, as ids may lie further apart than 64 bits reach."""
    wide = "DECIMAL(20, 0)"
    steps = f"CAST((CAST(doc_id AS {wide}) - CAST({low} AS {wide})) DIV CAST({width} AS {wide}) AS {wide})"
    return f"CAST(CAST({low} AS {wide}) + {steps} * CAST({width} AS {wide}) AS LONG)"


def _split(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows of the ranges in ``cuts`` (r, low, width) in finer ranges, the others as they are."""
    finer = F.expr(_range("low", "width"))
    return rows.join(cuts, "r", "left").withColumn("r", F.coalesce(finer, "r")).drop("low", "width")


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with the range ``r`` they belong to, and the largest id ``top`` of each range.

    A range is named by an id, ascending with its documents. Ranges of equal
    width hold about ``RANGE`` documents where ids lie evenly. One that holds
    more than twice as many is cut again between its own smallest and largest
    id, until none does; only rows of one and the same id stay together.
    Counts are taken on ids, and texts are not moved by it. Rows without id
    have no range.
    """
    low, high, count = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    low, high, count = low or 0, high or 0, max(count, 1)
    width = max((high - low) // max(count // RANGE, 1) + 1, 1)
    docs = docs.withColumn("r", F.when(F.col("doc_id").isNotNull(), F.expr(_range(f"'{low}'", f"'{width}'"))))
    ids, tops = docs.select("doc_id", "r").where("r IS NOT NULL"), []
    while True:
        ranges = kept(ids.groupBy("r").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("top")), "ranges")
        large = f"n > {2 * RANGE} AND low < top"
        tops.append(ranges.where(f"NOT ({large})").select("r", "top"))
        cuts = ranges.where(large).select("r", "low", F.expr(f"CAST((CAST(top AS DECIMAL(20, 0)) - low) DIV (n DIV {RANGE}) AS DECIMAL(20, 0)) + 1").alias("width"))
        if cuts.isEmpty():
            break
        ids, docs = _split(ids.join(cuts, "r", "left_semi"), cuts), _split(docs, cuts)
    return docs, functools.reduce(DataFrame.union, tops)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of (range, place, doc_id, text, next_text), and the first row of the range below as place -1."""
    rows, tops = placed(docs)
    ends = kept(tops.join(_below(tops.select("r")), "r").select(F.col("top").alias("doc_id"), "above"), "ends")
    tails = docs.join(ends, "doc_id").select("doc_id", "text", F.col("above").alias("r"), F.lit(True).alias("tail"))
    rows = rows.where("r IS NOT NULL").select("doc_id", "text", "r", F.lit(False).alias("tail")).union(tails)
    order = Window.partitionBy("r").orderBy("tail", F.col("doc_id").desc(), "text")
    return rows.select("r", F.row_number().over(order).alias("place"), "tail", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, with their likeness.

    The edited text has its last half (rounded down) replaced by as many
    characters from the start of the next document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    stray = docs.where("doc_id IS NULL").select(
        F.lit(None).cast("long").alias("r"), F.lit(1).alias("place"), F.lit(False).alias("tail"), "doc_id", "text",
        F.lit("").alias("next_text"),
    )

    def finished(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
        rows = hold(rows, "edited", F.expr("concat(left(text, CAST(n_chars - n_chars DIV 2 AS int)), left(coalesce(next_text, ''), CAST(n_chars DIV 2 AS int)))"))
        rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("next_text")
        rows = fingerprint(rows, "text", "fingerprint").drop("text")
        return fingerprint(rows, "edited", "edited_fingerprint").drop("edited")

    rows = finished(with_next(docs))
    after = F.lead("fingerprint").over(Window.partitionBy("r").orderBy("place"))
    rows = rows.withColumn("next_fingerprint", after).where("NOT tail")
    rows = rows.union(finished(stray).withColumn("next_fingerprint", F.lit("")))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
