"""Running a stream over what is there, and reading its results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import first_n


#: Buckets of a table of state; a batch writes those that its keys fall into.
BUCKETS = 64

# State lies in RocksDB and a batch writes its changes; whole snapshots are taken in the background.
# Batches without rows are left out: nothing here waits for a time to pass.
_STATE = {
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _start(stream: DataFrame, checkpoint: str, mode: str, keep: Callable[[DataFrame, int], None]) -> None:
    for key, value in _STATE.items():
        stream.sparkSession.conf.set(key, value)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str, each: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process what has arrived and stop; every batch goes to a folder of its own.

    A repeated batch overwrites its folder, so results do not double after a
    failure. ``each`` is applied to every batch before it is written.
    """

    def keep(rows: DataFrame, batch_id: int) -> None:
        (each(rows) if each else rows).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _start(stream, checkpoint, mode, keep)


def write_log(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what has arrived to a table that other streams read; a row comes once, also after a failure."""
    for key, value in _STATE.items():
        stream.sparkSession.conf.set(key, value)
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.format("parquet").start(path).awaitTermination()


def _drop(spark: SparkSession, path: str) -> None:
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def write_steps(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    step: Callable[[DataFrame, DataFrame], Sequence[DataFrame]],
    state: str,
    key: str,
    each: Callable[[DataFrame], DataFrame] | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Process what has arrived, with a table of state that passes from batch to batch.

    ``step`` gets the rows of a batch (after ``each``) and the state of their
    buckets, and returns the results and that state after the batch; what
    follows in its answer is released afterwards. The table is cut into
    ``buckets`` by the hash of ``key``. A batch reads and writes only the
    buckets it has keys in, as new versions; a list of ``buckets`` numbers says
    which version is the present one. A repeated batch starts from the versions
    before it and overwrites its own. Without its folder of state a stream
    cannot go on: the read of the list fails.
    """
    spark = stream.sparkSession
    root = f"{path}-state"
    bucket = F.pmod(F.hash(key), F.lit(buckets))

    def keep(rows: DataFrame, batch_id: int) -> None:
        rows = (each(rows) if each else rows).persist()
        touched = sorted(r[0] for r in rows.select(bucket.alias("bucket")).distinct().collect())
        versions = present_versions(spark, path, batch_id - 1) if batch_id else {}
        held = [f"{root}/batch={versions[b]}/bucket={b}" for b in touched if b in versions]
        before = spark.read.schema(state).parquet(*held) if held else spark.createDataFrame([], state)
        results, after, *used = step(rows, before)
        after.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/batch={batch_id}")
        results.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        now = versions | dict.fromkeys(touched, batch_id)
        spark.createDataFrame(list(now.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{root}-versions/batch={batch_id}")
        for df in (rows, *used):
            df.unpersist()
        if batch_id >= 2:
            # what the batch before replaced is needed by nobody any more
            for b, old in present_versions(spark, path, batch_id - 2).items():
                if versions[b] != old:
                    _drop(spark, f"{root}/batch={old}/bucket={b}")
            _drop(spark, f"{root}-versions/batch={batch_id - 2}")

    _start(stream, checkpoint, "append", keep)


def present_versions(spark: SparkSession, path: str, batch_id: int) -> dict[int, int]:
    """Batch that wrote each bucket of a stream's state, as of a batch."""
    return {r["bucket"]: r["batch"] for r in spark.read.parquet(f"{path}-state-versions/batch={batch_id}").collect()}


def read_state(spark: SparkSession, path: str, batch_id: int, state: str) -> DataFrame:
    """The table of state of a stream after a batch."""
    versions = present_versions(spark, path, batch_id)
    if not versions:
        return spark.createDataFrame([], state)
    return spark.read.schema(state).parquet(*[f"{path}-state/batch={n}/bucket={b}" for b, n in versions.items()])


def latest(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last written row of every key, for streams in update mode."""
    return first_n(batches, list(keys), [F.col("batch").desc()], 1).drop("batch", "position")
