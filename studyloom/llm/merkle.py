"""Merkle manifest of a table of documents, with octopus multiproofs.

H is the lowercase hexadecimal SHA-256 of its inputs, concatenated; digests go
in as hexadecimal text. A leaf is H of doc_id, source, lang, n_chars and text,
each ``-`` where null, else its length in UTF-8 bytes, ``:`` and its value. The
leaves of a language ascend by doc_id and make a binary tree: every two
neighbours become their H, a last one without neighbour becomes the H of itself,
until one is left, the subroot. The subroots, by language, make the root in the
same way.

Leaves are dealt into partitions of ``2^BLOCK_LEVELS`` neighbours. A partition
builds its part of the tree by itself, and its top is a leaf of the tier above,
so a tree of any size takes a few rounds of bounded groups. To prove leaves, a
partition works out which coordinates it lacks: the siblings, level by level, of
what its leaves and the nodes above them already give, each one once. It fetches
them in one join, derives the shared interior nodes, and reads the path of every
leaf off them. A node far up is wanted by many partitions, so it has one copy
for ``2^CHUNK_LEVELS`` of them.

Rows: a null language is a language of its own, before all others. A row without
id comes before those with one. Rows that share an id follow each other by leaf,
so repeated rows give neighbouring equal leaves. Null and empty texts have
different leaves. An empty table has no root and gives an empty result. Other
columns are not read. Every input row gives one output row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
BLOCK_LEVELS = 10
CHUNK_LEVELS = 10
#: Levels of rows that tell a partition about the tree above its own.
_SUBROOT, _ABOVE = 1000, 1001

_NODE = "tree string, level int, idx long, digest string, size long"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _framed(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Leaf of a row, with some of its fields replaced."""
    return F.sha2(F.concat(*[_framed(changed.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the slice and the place inside it of rows that come sorted by tree."""
    part = TaskContext.get().partitionId()
    tree, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("tree").dictionary_encode()
        code = names.indices.to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        place = np.arange(batch.num_rows) - np.repeat(heads, np.diff(np.append(heads, batch.num_rows)))
        first, last = (names.dictionary[int(code[i])].as_py() for i in (0, -1))
        if first == tree:
            place[: heads[1] if len(heads) > 1 else None] += seen
        tree, seen = last, int(place[-1]) + 1
        yield pa.record_batch(
            [*batch.columns, pa.array(np.full(batch.num_rows, part, dtype=np.int32)), pa.array(place.astype(np.int64))],
            names=[*batch.schema.names, "slice", "place"],
        )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their place ``idx`` in their ``tree``, and the size of that tree.

    Rows are dealt by ranges of the whole order, equal ones at random, so a
    tree that holds most rows is spread like any other.
    """
    ranged = rows.repartitionByRange("tree", *order, F.rand(1)).sortWithinPartitions("tree", *order)
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    numbered = kept(ranged.mapInArrow(_numbered, f"{fields}, slice int, place long"), "numbered")
    slices = Window.partitionBy("tree").orderBy("slice")
    counts = numbered.groupBy("tree", "slice").agg(F.count("*").alias("n"))
    offsets = counts.select(
        "tree", "slice",
        (F.sum("n").over(slices) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy("tree")).alias("size"),
    )
    return kept(
        numbered.join(kept(offsets, "offsets"), ["tree", "slice"])
        .select(*rows.columns, (F.col("place") + F.col("before")).alias("idx"), "size"),
        "placed",
    )


def _above(digests: list[str]) -> list[str]:
    return [digest("".join(digests[i : i + 2])) for i in range(0, len(digests), 2)]


def _subtree(height: int):
    """Nodes above one partition of a tier, up to its top or the root of the tree."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        tree, level, first, size = (table.column(c)[0].as_py() for c in ("tree", "level", "idx", "size"))
        nodes, out = table.column("digest").to_pylist(), {"level": [], "idx": [], "digest": [], "size": []}
        for _ in range(height):
            if size == 1:
                break
            nodes, level, first, size = _above(nodes), level + 1, first >> 1, (size + 1) >> 1
            out["level"] += [level] * len(nodes)
            out["idx"] += range(first, first + len(nodes))
            out["digest"] += nodes
            out["size"] += [size] * len(nodes)
        return pa.table({
            "tree": pa.array([tree] * len(out["idx"]), pa.string()),
            "level": pa.array(out["level"], pa.int32()),
            "idx": pa.array(out["idx"], pa.int64()),
            "digest": pa.array(out["digest"], pa.string()),
            "size": pa.array(out["size"], pa.int64()),
        })

    return run


def nodes_over(leaves: DataFrame, height: int) -> DataFrame:
    """All nodes (tree, level, idx, digest, size of the level) over placed leaves (tree, idx, size, leaf)."""
    tier = leaves.select("tree", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"), "size")
    nodes, level = tier, 0
    while True:
        open_ = tier.where(f"size > 1 AND level = {level}")
        if not open_.limit(1).count():
            return nodes
        grouped = open_.withColumn("block", F.shiftright("idx", height)).groupBy("tree", "block")
        tier = kept(grouped.applyInArrow(_subtree(height), _NODE), "nodes")
        nodes, level = nodes.union(tier), level + height


def missing(idx: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Coordinates a multiproof of these leaves lacks: for each level the siblings that nothing below gives."""
    known, level = np.unique(idx), 0
    while size > 1:
        beside = known ^ 1
        beside = beside[(beside < size) & ~np.isin(beside, known)]
        if len(beside):
            yield level, beside
        known, level, size = np.unique(known >> 1), level + 1, (size + 1) >> 1


def _lacking(table: pa.Table) -> pa.Table:
    tree, block, size = (table.column(c)[0].as_py() for c in ("tree", "block", "size"))
    found = list(missing(table.column("idx").to_numpy(), size))
    idx = np.concatenate([x for _, x in found]) if found else np.zeros(0, dtype=np.int64)
    level = np.repeat([level for level, _ in found], [len(x) for _, x in found]).astype(np.int32)
    return pa.table({
        "tree": pa.array([tree] * len(idx), pa.string()), "block": pa.array(np.full(len(idx), block, dtype=np.int64)),
        "level": pa.array(level, pa.int32()), "idx": pa.array(idx, pa.int64()),
    })


def _expand(wanted: pa.Table, fetched: pa.Table) -> pa.Table:
    """Proof of every wanted leaf of a partition, from its leaves and the nodes it fetched."""
    idx, size = wanted.column("idx").to_numpy(), wanted.column("size")[0].as_py()
    leaves, given = wanted.column("leaf").to_pylist(), wanted.column("given").to_pylist()
    levels: dict[int, dict[int, str]] = {0: dict(zip(idx.tolist(), leaves))}
    more: list[tuple[int, str]] = []
    subroot = None
    for level, i, x in zip(*(fetched.column(c).to_pylist() for c in ("level", "idx", "digest"))):
        if level == _SUBROOT:
            subroot = x
        elif level >= _ABOVE:
            more.append((level, i, x))
        else:
            levels.setdefault(level, {})[i] = x
    sizes, level = [size], 0
    while sizes[-1] > 1:
        # interior nodes, each derived once for all leaves of the partition
        here, up = levels[level], levels.setdefault(level + 1, {})
        for parent in {i >> 1 for i in here}:
            low, high = here.get(2 * parent), here.get(2 * parent + 1)
            if low is not None and (high is not None or 2 * parent + 1 >= sizes[-1]):
                up.setdefault(parent, digest(low + (high or "")))
        level += 1
        sizes.append((sizes[-1] + 1) >> 1)
    more.sort()
    end, end_left = [x for _, _, x in more if x is not None], [(i & 1) == 1 for _, i, x in more]
    rows: dict[str, list] = {"proof": [], "folded": []}
    for i, own in zip(idx.tolist(), given):
        path, at = [], i
        for level in range(len(sizes) - 1):
            other = levels[level][at ^ 1] if at ^ 1 < sizes[level] else None
            if other is None:
                own = digest(own)
            else:
                own = digest(other + own if at & 1 else own + other)
                path.append(other)
            at >>= 1
        for (_, _, other), before in zip(more, end_left):
            own = digest(own) if other is None else digest(other + own if before else own + other)
        rows["proof"].append(path + end)
        rows["folded"].append(own)
    return pa.table({
        "doc_id": wanted.column("doc_id"),
        "leaf": wanted.column("leaf"),
        "subroot": pa.array([subroot] * len(idx), pa.string()),
        "proof": pa.array(rows["proof"], pa.list_(pa.string())),
        "folded_root": pa.array(rows["folded"], pa.string()),
    })


@dataclass(frozen=True)
class Manifest:
    """Placed leaves, all nodes, and per tree its subroot and the way from there to the root."""

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame
    root: str | None
    height: int


def manifest(docs: DataFrame, given: Column | None = None, height: int = BLOCK_LEVELS) -> Manifest:
    """Manifest of ``docs``; ``given`` is a digest per row to be verified in place of its leaf.

    ``height`` is that of the partitions: they hold ``2^height`` leaves.
    """
    docs = docs.select(*[F.col(c) for c in FIELDS])
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"),
        (F.lit(None).cast("string") if given is None else given).alias("given"),
    )
    leaves = placed(kept(rows.withColumn("given", F.coalesce("given", "leaf")), "leaves"), ["doc_id", "leaf"])
    nodes = nodes_over(leaves, height)
    subroots = nodes.where("size = 1").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest").alias("leaf"))
    languages = placed(kept(subroots, "subroots"), ["name"])
    upper = nodes_over(languages, height)
    top = upper.where("size = 1").select("digest").first()
    # levels above the subroots: their number grows with the logarithm of the number of languages
    levels = upper.agg(F.max("level")).first()[0] or 0
    way = languages.select("name", F.col("leaf").alias("subroot"), "idx", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    way = way.withColumn("own", F.expr("shiftright(idx, level)")).withColumn("beside", F.expr("own ^ 1"))
    beside = upper.select("level", F.col("idx").alias("beside"), "digest")
    tops = kept(
        way.join(beside, ["level", "beside"], "left").where(F.col("level") < levels).select(
            F.col("name").alias("tree"), (F.lit(_ABOVE) + F.col("level")).alias("level"), F.col("own").alias("idx"), "digest"
        ).union(languages.select("name", F.lit(_SUBROOT), F.lit(0).cast("long"), "leaf")),
        "tops",
    )
    return Manifest(leaves, nodes, tops, top[0] if top else None, height)


def proofs(made: Manifest, wanted: Column | None = None, chunk_levels: int = CHUNK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof and folded_root of the wanted leaves (default: all).

    ``proof`` lists the siblings from the leaf up to the root; ``folded_root``
    is what they make of the digest to be verified.
    """
    rows = made.leaves if wanted is None else made.leaves.where(wanted)
    rows = rows.withColumn("block", F.shiftright("idx", made.height))
    lacking = kept(
        rows.select("tree", "block", "idx", "size").groupBy("tree", "block")
        .applyInArrow(_lacking, "tree string, block long, level int, idx long"),
        "lacking",
    )
    chunk = made.height + chunk_levels
    low = lacking.agg(F.min("level")).first()[0] or 0
    # a copy of a node for each chunk of partitions below its sibling
    copies = made.nodes.where((F.col("size") > 1) & (F.col("level") >= low)).select(
        "tree", "level", "idx", "digest",
        F.explode(F.expr(
            f"sequence(shiftright(shiftleft(idx ^ 1, level), {chunk}), shiftright(shiftleft((idx ^ 1) + 1, level) - 1, {chunk}))"
        )).alias("chunk"),
    )
    asked = lacking.withColumn("chunk", F.shiftright("block", chunk_levels))
    fetched = asked.join(copies, ["tree", "level", "idx", "chunk"]).select("tree", "block", "level", "idx", "digest")
    blocks = rows.select("tree", "block").distinct()
    above = blocks.join(made.tops, "tree").select("tree", "block", "level", "idx", "digest")
    out = (
        rows.groupBy("tree", "block").cogroup(fetched.union(above).groupBy("tree", "block"))
        .applyInArrow(_expand, "doc_id long, leaf string, subroot string, proof array<string>, folded_root string")
    )
    return out.withColumn("root", F.lit(made.root).cast("string"))


def report(docs: DataFrame, tampered: Column, height: int = BLOCK_LEVELS, chunk_levels: int = CHUNK_LEVELS) -> DataFrame:
    """Leaf, roots and proof of every document, and whether the proof holds.

    Where ``tampered`` is true, one is added to n_chars of what is verified;
    the manifest is that of ``docs`` as they are.
    """
    changed = F.when(F.coalesce(tampered, F.lit(False)), leaf(n_chars=F.try_add(F.col("n_chars"), F.lit(1))))
    return proofs(manifest(docs, changed, height), chunk_levels=chunk_levels).select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
