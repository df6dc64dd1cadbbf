"""Writers and snapshot updates.

Updates return the new snapshot; the caller writes it to a new folder, since a
table cannot be overwritten while it is being read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import first_n


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a table (writes)."""
    rows.write.mode("append").parquet(path)


def write_snapshot(rows: DataFrame, path: str) -> DataFrame:
    """Write a table to a new folder and read it back: plain lineage, safe to lose executors."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_files(rows: DataFrame, root: str) -> None:
    """One text file below ``root`` for each path of ``rows`` (path, value), its values ended by line breaks (writes).

    Tasks write the files themselves, to any store that Arrow opens by its URI, so a
    file costs no folder, no commit and no rename. A repeated task writes the same
    files again. Rows without a path are left out, null values are empty lines.
    """
    folder = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).mkdirs(folder)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        made, name, out, files = set(), None, None, 0
        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").cast(pa.binary()).to_pylist()):
                if path != name:
                    if out:
                        out.close()
                    parent = f"{base}/{path}".rsplit("/", 1)[0]
                    if parent not in made:
                        store.create_dir(parent, recursive=True)
                        made.add(parent)
                    name, out, files = path, store.open_output_stream(f"{base}/{path}"), files + 1
                out.write((value or b"") + b"\n")
        if out:
            out.close()
        yield pa.record_batch({"files": pa.array([files])})

    # rows of one path lie next to each other in one task
    dealt = rows.where("path IS NOT NULL").select("path", "value").repartition("path").sortWithinPartitions("path")
    dealt.mapInArrow(put, "files long").agg({"files": "sum"}).collect()


def insert_if_absent(
    existing: DataFrame, new: DataFrame, keys: Sequence[str], reactivate: str | None = None
) -> DataFrame:
    """Existing rows plus those new ones whose key is not there yet.

    With ``reactivate`` the named flag becomes true on existing rows whose key
    comes again. Of several new rows with one key the smallest is taken.
    """
    rest = [c for c in existing.columns if c not in keys]
    first = first_n(new, keys, [F.col(c) for c in rest], 1).select(*keys, *rest)
    added = first.join(existing, list(keys), "left_anti")
    if reactivate:
        again = new.select(*keys).distinct().withColumn("__again", F.lit(True))
        existing = (
            existing.join(again, list(keys), "left")
            .withColumn(reactivate, F.col(reactivate) | F.coalesce("__again", F.lit(False)))
            .drop("__again")
        )
    return existing.select(*added.columns).unionByName(added)


def merge_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Add chunks by id. An id already stored stays; of equal new ids the first path wins."""
    first = first_n(new, ["id"], [F.col("path"), F.col("pos")], 1).drop("position")
    return existing.unionByName(first.join(existing.select("id"), "id", "left_anti"))


def delete_owned(
    parent: DataFrame, requests: DataFrame, children: Mapping[str, tuple[DataFrame, str]] | None = None
) -> dict[str, DataFrame]:
    """Delete rows whose requester owns them, and the children of those rows.

    ``parent`` has id and owner_id, ``requests`` id and user_id. ``children``
    maps a name to (rows, column that holds the parent id). Returns what is
    left, the parent under "parent".
    """
    asked = requests.select("id", F.col("user_id").alias("owner_id"))
    deleted = parent.join(asked, ["id", "owner_id"], "left_semi").select("id")
    left = {"parent": parent.join(deleted, "id", "left_anti")}
    for name, (rows, column) in (children or {}).items():
        left[name] = rows.join(deleted.withColumnRenamed("id", column), column, "left_anti")
    return left


def forget_best(progress: DataFrame, deleted_submissions: DataFrame) -> DataFrame:
    """Null ``best_submission`` where that submission was deleted."""
    gone = deleted_submissions.select(F.col("id").alias("best_submission"), F.lit(True).alias("__gone"))
    return (
        progress.join(gone, "best_submission", "left")
        .withColumn("best_submission", F.when(F.col("__gone").isNull(), F.col("best_submission")))
        .select(*progress.columns)
    )


def apply_counts(base: DataFrame, events: DataFrame, key: str, counter: str) -> DataFrame:
    """Add the number of events per key to a counter column."""
    counts = events.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("__n"))
    return (
        base.join(counts, "id", "left")
        .withColumn(counter, F.col(counter) + F.coalesce("__n", F.lit(0)))
        .drop("__n")
    )
