"""Course corpus: sections, modules, chunks.

``files``: path, name, parent, type. ``pages``: path, page, text.
``index``: module, section, section_pos, file, file_pos.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as txt
from .ordered import first_n, positions, running_sums

# Fixed values of the corpus rules.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ["\n\n", "\n", " ", ""]
RESOURCES_FOLDER = "resources"
RESOURCES_INDEX = "ressources"
RESOURCES_SECTION = "ressources"
UNKNOWN = "unknown"
GENERAL_MODULE = ("general", "General", "General questions on all topics")
PAGES_PER_SLICE = 1000
CUT_CHARS = 1 << 20  # text that is cut at a time


def modules(index: DataFrame) -> DataFrame:
    return index.select("module").distinct()


def file_sections(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files with the first section of their index that lists them, or null.

    Files in a module folder look in that module's index, files in the
    resources folder in the resources index.
    """
    rows = index.where("file is not null").select("module", F.col("file").alias("name"), "section", "section_pos")
    listed = first_n(rows, ["module", "name"], [F.col("section_pos")], 1).select("module", "name", "section")
    known = modules(index).withColumn("is_module", F.lit(True))
    placed = (
        files.join(known.withColumnRenamed("module", "parent"), "parent", "left")
        .withColumn("is_module", F.coalesce("is_module", F.lit(False)))
        .withColumn(
            "module",
            F.when(F.col("is_module") | (F.col("parent") != RESOURCES_FOLDER), F.col("parent")).otherwise(
                RESOURCES_INDEX
            ),
        )
    )
    return placed.join(listed, ["module", "name"], "left").drop("module")


def classify(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files with their section."""
    by_name = F.when(F.col("name").contains("__"), F.substring_index("name", "__", 1)).otherwise(RESOURCES_SECTION)
    section = (
        F.when(F.col("is_module"), F.coalesce("section", F.lit(UNKNOWN)))
        .when(F.col("parent") == RESOURCES_FOLDER, F.coalesce(F.col("section"), by_name))
        .otherwise(UNKNOWN)
    )
    return file_sections(files, index).withColumn("section", section).drop("is_module")


def covered(files: DataFrame, module_rows: DataFrame) -> DataFrame:
    """Resource files whose section is the part of a module key after its first underscore."""
    topics = (
        module_rows.where(F.col("module").contains("_"))
        .select(F.regexp_extract(F.lower("module"), r"(?s)^[^_]*_(.*)$", 1).alias("section"))
        .distinct()
    )
    return files.join(topics, "section", "left_semi")


def stamp(files: DataFrame) -> DataFrame:
    """Metadata of the chunks of a file."""
    return files.withColumn(
        "metadata",
        F.struct(F.col("name").alias("source"), txt.suffix(F.col("name")).alias("type"), F.col("section")),
    )


def union_corpora(courses: DataFrame, resources: DataFrame) -> DataFrame:
    """Course files first, resource files second."""
    return courses.withColumn("corpus", F.lit("courses")).unionByName(
        resources.withColumn("corpus", F.lit("resources"))
    )


def needs_split(pages: DataFrame, threshold: int = CHUNK_SIZE) -> DataFrame:
    """Per file: whether its first page reaches the threshold."""
    first = pages.groupBy("path").agg(F.min_by(F.length("text"), F.col("page")).alias("first_length"))
    return first.withColumn("needs_split", F.col("first_length") >= threshold)


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, level: int = 0) -> list[str]:
    """Chunks of at most ``size`` characters where the separators allow it.

    The text is cut at the first separator that occurs; a separator opens the
    piece after it. Pieces that are still too long are cut at the next
    separators, the others are put together until the next would not fit.
    """
    while SEPARATORS[level] and SEPARATORS[level] not in text:
        level += 1
    mark = SEPARATORS[level]
    if mark:
        head, *tail = text.split(mark)
        pieces = [p for p in [head, *(mark + t for t in tail)] if p]
    else:
        pieces = list(text)
    chunks: list[str] = []
    waiting: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            waiting.append(piece)
            continue
        chunks += _pack(waiting, size, overlap)
        waiting = []
        chunks += split_text(piece, size, overlap, level + 1) if mark else [piece]
    return chunks + _pack(waiting, size, overlap)


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Join neighbouring pieces up to ``size``; a new chunk repeats up to ``overlap`` of the old."""
    begin = held = 0
    out = []
    for end, piece in enumerate(pieces):
        if held + len(piece) > size and end > begin:
            out.append("".join(pieces[begin:end]).strip())
            while held > overlap or (held and held + len(piece) > size):
                held -= len(pieces[begin])
                begin += 1
        held += len(piece)
    out.append("".join(pieces[begin:]).strip())
    return [c for c in out if c]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring texts of about ``CUT_CHARS`` bytes together, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        upto = int(ends[begin - 1]) if begin else 0
        end = max(int(np.searchsorted(ends, upto + CUT_CHARS, side="right")), begin + 1)
        yield texts.slice(begin, end - begin)
        begin = end


def chunk_lists(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Pages with the list of their chunks (path, page, parts).

    Files whose first page is short are kept whole. Only texts that need it are
    cut in Python, in Arrow batches, once each.
    """

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        # texts and chunks are objects of Python for a few texts at a time only
        done = []
        for some in _slices(texts):
            parts = [None if t is None else split_text(t, size, overlap) for t in some.to_pylist()]
            done.append(pa.array(parts, pa.list_(pa.string())))
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.string()))

    decided = pages.join(needs_split(pages.select("path", "page", "text"), size), "path")
    parts = F.coalesce(cut(F.when(F.col("needs_split"), F.col("text"))), F.array("text"))
    return decided.select("path", "page", parts.alias("parts"))


def chunk(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Pages as chunks (path, page, pos, text)."""
    lists = chunk_lists(pages, size, overlap)
    return lists.select("path", "page", F.posexplode("parts").alias("pos", "text"))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Chunks (path, page, pos, text) with id "<stem>-<i>", counting over all pages of a file."""
    return _numbered(chunks, chunks.groupBy("path", "page").agg(F.count("*").alias("n")))


def listed_chunk_ids(lists: DataFrame) -> DataFrame:
    """The same for pages with their lists of chunks; read twice, so write them first."""
    chunks = lists.select("path", "page", F.posexplode("parts").alias("pos", "text"))
    return _numbered(chunks, lists.select("path", "page", F.size("parts").cast("long").alias("n")))


def _numbered(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """Counted per page first, so a file with very many pages is not sorted in one task."""
    paged = running_sums(
        counts.withColumn("block", F.floor(F.col("page") / PAGES_PER_SLICE)),
        ["path"],
        [("block", False)],
        [F.col("page")],
        {"upto": F.col("n")},
    ).select("path", "page", (F.col("upto") - F.col("n")).alias("before"))
    name = txt.stem(txt.file_name(F.col("path")))
    number = (F.col("before") + F.col("pos")).cast("string")
    return chunks.join(paged, ["path", "page"]).select(
        F.concat(name, F.lit("-"), number).alias("id"), "path", "page", "pos", "text"
    )


def module_stats(index: DataFrame) -> DataFrame:
    """Per module: name, description, number of sections and of files.

    Counted per section first; the description needs the first three only.
    """
    per_section = index.groupBy("module", "section_pos", "section").agg(F.count("file").alias("files"))
    opening = (
        first_n(per_section, ["module"], [F.col("section_pos"), F.col("section")], 3)
        .groupBy("module")
        .agg(F.sort_array(F.collect_list(F.struct("position", "section"))).alias("opening"))
    )
    counts = per_section.groupBy("module").agg(
        F.count("*").alias("sections_count"), F.sum("files").alias("files_count")
    )
    first = F.transform("opening", lambda s: s["section"])
    return counts.join(opening, "module").select(
        F.col("module").alias("id"),
        txt.module_display_name(F.col("module")).alias("name"),
        txt.module_description(first, F.col("sections_count")).alias("description"),
        "sections_count",
        "files_count",
    )


def with_general(module_rows: DataFrame) -> DataFrame:
    """Modules with the general one in front."""
    names = dict(zip(("id", "name", "description"), GENERAL_MODULE))
    row = module_rows.sparkSession.range(1).select(
        *[F.lit(v).alias(k) for k, v in names.items()],
        F.lit(0).cast("long").alias("sections_count"),
        F.lit(0).cast("long").alias("files_count"),
        F.lit(0).alias("place"),
    )
    return row.unionByName(module_rows.withColumn("place", F.lit(1)))


def with_module_name(courses: DataFrame, module_rows: DataFrame, saved: bool = True) -> DataFrame:
    """Courses with the display name of their module.

    A saved course falls back to its key in title case and has no name for the
    general module; a new one falls back to the key as it is.
    """
    names = module_rows.select(F.col("id").alias("module"), F.col("name").alias("__name"))
    key = F.col("module")
    if saved:
        own = F.coalesce("__name", txt.title_case(F.replace(key, F.lit("_"), F.lit(" "))))
        shown = F.when((key != "") & (key != GENERAL_MODULE[0]), own)
    else:
        shown = F.coalesce("__name", key)
    return courses.join(names, "module", "left").withColumn("module_name", shown).drop("__name")


def sections(index: DataFrame) -> DataFrame:
    """Sections of every module with display name and number of files.

    The files themselves are the rows of the index.
    """
    return (
        index.groupBy("module", "section_pos", "section")
        .agg(F.count("file").alias("files_count"))
        .withColumn("name", txt.title_case(F.replace("section", F.lit("_"), F.lit(" "))))
    )


def _cuts(text, sizes):
    """Distinct substrings of the given sizes, with shorter ones at the end."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    cuts = F.transform(at, lambda i: F.array(*[F.substring(text, i, F.lit(n)) for n in sizes]))
    return F.array_distinct(F.flatten(cuts))


def _name_grams(name):
    """All substrings a query can be looked up by: up to three characters, and the empty one."""
    return F.array_union(F.array(F.lit("")), _cuts(name, (1, 2, 3)))


def _query_grams(needle):
    """The three-character substrings of a query; a shorter query is its own."""
    return F.when(F.length(needle) < 3, F.array(needle)).otherwise(
        F.filter(_cuts(needle, (3,)), lambda g: F.length(g) == 3)
    )


def _searched_names(index: DataFrame) -> DataFrame:
    """Lower-cased names of sections and files, with the place that finds them again; sections have file_pos -1."""
    sections_ = index.select("module", "section_pos", F.lit(-1).cast("long").alias("file_pos"), F.lower("section").alias("name")).distinct()
    files = index.where("file is not null").select("module", "section_pos", "file_pos", F.lower("file").alias("name"))
    return sections_.unionByName(files)


def _needles(queries: DataFrame) -> DataFrame:
    return queries.select("module", F.lower("query").alias("needle")).distinct()


def name_postings(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Substrings of up to three characters that the queries ask for, with the names that hold them.

    The result is read twice by :func:`search_index`; write it where the index is large.
    """
    asked = _needles(queries).select("module", F.explode(_query_grams(F.col("needle"))).alias("gram")).distinct()
    return _searched_names(index).withColumn("gram", F.explode(_name_grams(F.col("name")))).join(asked, ["module", "gram"], "left_semi")


def search_index(index: DataFrame, queries: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """Sections and files of a module whose name contains a query.

    ``queries``: query_id, module, query. A distinct query is looked up by the
    rarest of its three-character substrings, so it meets few names besides
    its hits; then the whole query is looked for. What else a hit shows is
    fetched for the hits only. ``postings``: :func:`name_postings` of the two.
    """
    postings = name_postings(index, queries) if postings is None else postings
    frequency = postings.groupBy("module", "gram").agg(F.count("*").alias("n"))
    grams = _needles(queries).withColumn("gram", F.explode(_query_grams(F.col("needle")))).join(frequency, ["module", "gram"])
    lookup = first_n(grams, ["module", "needle"], [F.col("n"), F.col("gram")], 1).select("module", "needle", "gram")
    found = (
        postings.join(lookup, ["module", "gram"])
        .where(F.col("name").contains(F.col("needle")))
        .select("module", "needle", "name", "section_pos", "file_pos")
    )
    none = F.lit(None).cast("string").alias("file")
    shown = index.select("module", "section_pos", F.lit(-1).cast("long").alias("file_pos"), "section", none).distinct()
    shown = shown.unionByName(index.where("file is not null").select("module", "section_pos", "file_pos", "section", "file"))
    high = (F.col("file_pos") >= 0) | (F.col("name") == F.col("needle"))
    asked = queries.select("query_id", "module", F.lower("query").alias("needle"))
    return (
        found.join(shown, ["module", "section_pos", "file_pos"])
        .join(asked, ["module", "needle"])
        .select(
            "query_id", "module", F.when(F.col("file_pos") < 0, "section").otherwise("file").alias("type"), "section", "file",
            F.when(high, "high").otherwise("medium").alias("relevance"), "section_pos", "file_pos",
        )
    )


def by_relevance(hits: DataFrame) -> DataFrame:
    """Hits numbered per query: high relevance first, then in order of the index."""
    rows = hits.withColumn("lower_rank", (F.col("relevance") != "high").cast("int")).withColumn(
        "block", F.floor(F.col("file_pos") / PAGES_PER_SLICE)
    )
    slices = [("lower_rank", False), ("section_pos", False), ("block", False)]
    return positions(rows, ["query_id"], slices, [F.col("file_pos")]).drop("lower_rank", "block")
