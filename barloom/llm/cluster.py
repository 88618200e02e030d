"""What the operators need from a session: their code on the executors, and a shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

import barloom
from barloom.session import cut

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, as a Python archive, so it need not be installed there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(barloom.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "barloom_code.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB for this session, unless it has a limit of its own: rows are whole texts or vectors here, and a batch
    is held by the JVM and by Python at once. Spark's default limit is 64 MB and 10,000 rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(4 << 20))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder of spark.checkpoint.dir, which all executors see.

    A local folder is used only for a local master that has none set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new table in the shared folder and read from there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


__all__ = ["cut", "shared_folder", "ship", "small_batches", "stored"]
