"""A corpus in four stages, each on all that the one before it kept.

Documents in no language go, one document of each group of near-duplicates
stays, passages that a document with a smaller id holds as well are cut, and
what is left is packed into sequences. Every stage but the last returns the
columns of its input.

Rows: language identification drops null texts and texts without letters. A row
without id passes the second and third stage unchanged. Of rows that share an
id one stays after the second stage. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from studyloom.llm import langid, minhash, packing, repeats
from studyloom.llm.queries import remainder, vocabulary
from studyloom.llm.tables import kept
from studyloom.session import scratch, shared_folder

#: Share of its words that a text's language must hold.
LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letters, or no language with ``LEAST_SHARE`` of the words."""
    return langid.accepted(docs, remainder(4) != 2, LEAST_SHARE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    first = kept(minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "firsts")
    # the ids grow with the corpus: the same join at every size
    rows = docs.join(first.hint("shuffle_merge"), "doc_id").select([f"`{c}`" for c in docs.columns]).dropDuplicates(["doc_id"])
    return rows.union(docs.where("doc_id IS NULL"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that a document with a smaller id holds as well."""
    return repeats.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 4096 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", pack),
]

#: SQL expresses neither the language model nor the packing; the tests replay the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = shared_folder(spark, name)
        with scratch(spark):  # what a stage writes on its way goes when its result is there
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(folder)
        docs = spark.read.schema(rows.schema).parquet(folder)
    return docs
