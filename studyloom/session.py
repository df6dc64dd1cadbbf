"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark import SparkFiles
from pyspark.sql import SparkSession

# Settings that the operators are tuned for. Shuffle partition counts are left
# to adaptive execution: start high, let it coalesce.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("studyloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders made inside ``scratch`` blocks, the innermost last.
_made: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Remove the shared folders made inside the block at its end.

    For steps whose result is written elsewhere: what they kept on the way is
    of no use after that.
    """
    _made.append([])
    try:
        yield
    finally:
        for folder in _made.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the one the cluster names in ``spark.checkpoint.dir``.

    A temporary folder of this machine is used only in local mode with the
    setting absent; on a cluster without the setting this raises, because
    executors could not see such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="studyloom-")
    folder = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(folder)
    return folder


_SHIPPED = "studyloom.zip"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of the session, once."""
    context = spark.sparkContext
    if any(name.rsplit("/", 1)[-1] == _SHIPPED for name in context.listFiles):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("studyloom", os.path.relpath(path, root)))
    # the driver serves the file from its own scratch folder, which ends with the session
    path = os.path.join(tempfile.mkdtemp(dir=SparkFiles.getRootDirectory()), _SHIPPED)
    with open(path, "wb") as out:
        out.write(body.getvalue())
    context.addPyFile(path)
