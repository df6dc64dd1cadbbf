"""Course folders: index files, content files, markdown and notebook texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsontext
from ..functions.text import file_name, parent_name, suffix

# File types of the corpus.
TEXT_TYPES = ["md", "ipynb", "pdf"]
IMAGE_TYPES = ["png", "jpg", "jpeg", "avif"]

# Small files cost their opening, so the sources put few of them into a task: at most so many tasks.
READ_TASKS = 1000

_INDEX_KEY = r"([^/=]*)_index\.json(?:/[^/]*)?$"


def index_rows(files: DataFrame) -> DataFrame:
    """Index texts (path, value) as rows (module, section, section_pos, file, file_pos).

    Empty, invalid and empty-object texts give no rows; a section without files
    keeps one row with null file. Key order follows the text.
    """
    parsed = F.from_json("value", "map<string,array<string>>", {"allowSingleQuotes": "false"})
    module = F.replace(F.regexp_extract("path", _INDEX_KEY, 1), F.lit("_index"), F.lit(""))
    whole = files.where(jsontext.alone(F.col("value")))
    sections = whole.select(module.alias("module"), parsed.alias("index")).where("index is not null")
    listed = sections.select("module", F.posexplode("index").alias("section_pos", "section", "files"))
    return listed.select(
        "module", "section", "section_pos", F.posexplode_outer("files").alias("file_pos", "file")
    )


def read_content_index(spark: SparkSession, folder: str) -> DataFrame:
    """All ``<module>_index.json`` of a folder: files, or folders of that name written by Spark."""
    texts = spark.read.text(f"{folder}/*_index.json", wholetext=True)
    # The path comes percent-encoded; a plus sign stands for itself.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return index_rows(texts.coalesce(READ_TASKS).select(path.alias("path"), "value"))


def read_content_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` of the supported types, with their bytes.

    ``length`` and the names need no file contents: select those alone and the
    bytes are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).coalesce(READ_TASKS)
    return supported(files.withColumn("path", named_path(F.col("path"))))


def named_path(path: Column) -> Column:
    """Path of a file; for ``key=name`` folders written by Spark that of the file they are named after."""
    whole = F.regexp_replace(path, r"(/[^/]*=[^/]*)/part-[^/]*$", "$1")
    return F.regexp_replace(whole, r"/[^/=]+=", "/")


def supported(files: DataFrame) -> DataFrame:
    """Files (path, length, content) of the supported types, with names taken from their paths."""
    kind = F.lower(suffix(file_name(F.col("path"))))
    return files.where(kind.isin(TEXT_TYPES + IMAGE_TYPES)).select(
        "path",
        file_name(F.col("path")).alias("name"),
        parent_name(F.col("path")).alias("parent"),
        suffix(file_name(F.col("path"))).alias("type"),
        "length",
        "content",
    )


def load_text(files: DataFrame) -> DataFrame:
    """Markdown files as one document each; files that are not UTF-8 are dropped."""
    raw = F.col("content").cast("string")
    return files.where((F.lower("type") == "md") & F.is_valid_utf8(raw)).select(
        "path", "name", "parent", "type", F.lit(0).alias("page"), F.regexp_replace(raw, r"\r\n?", "\n").alias("text")
    )


def _quoted(line: Column) -> Column:
    """A line as a Python string literal."""
    body = F.replace(line, F.lit("\\"), F.lit("\\\\"))
    for char, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(char), F.lit(code))
    double = line.contains("'") & ~line.contains('"')
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single)


def load_notebooks(files: DataFrame) -> DataFrame:
    """Notebook files as one document each: type and source of every cell in order."""
    raw = F.col("content").cast("string")
    cells = F.from_json(raw, "cells array<struct<cell_type: string, source: string>>")["cells"]

    def shown(cell):
        lines = F.from_json(cell["source"], "array<string>")
        listed = F.concat(F.lit("["), F.array_join(F.transform(lines, _quoted), ", "), F.lit("]"))
        return F.concat(
            F.lit("'"), cell["cell_type"], F.lit("' cell: '"), F.coalesce(listed, cell["source"]), F.lit("'\n\n")
        )

    return (
        files.where((F.lower("type") == "ipynb") & F.is_valid_utf8(raw))
        .withColumn("cells", cells)
        .where("cells is not null")
        .select(
            "path",
            "name",
            "parent",
            "type",
            F.lit(0).alias("page"),
            F.array_join(F.transform("cells", shown), " ").alias("text"),
        )
    )
