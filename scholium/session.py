"""What the engine needs from a session."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows in a batch for Python functions, where the session has Spark's default: texts are large.
BATCH_ROWS = 1024


def ready(spark: SparkSession) -> SparkSession:
    """Lets the session's Python workers import this package, where they see the same path, and get small batches.

    It changes the session: PYTHONPATH of its workers, and spark.sql.execution.arrow.maxRecordsPerBatch where that has
    Spark's default. A session with a value of its own keeps it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    root = str(Path(__file__).resolve().parent.parent)
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    A local default is set only where that setting is absent, as in tests on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "scholium-checkpoints")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


#: Folders that this process has named, for clear_scratch.
_scratch: list[str] = []


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder. It stays until clear_scratch, as results are read from it later."""
    _scratch.append(f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return _scratch[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Deletes the folders that fresh_dir has named in this process, once their results are written elsewhere, and says
    how many. Checkpoints go by themselves with spark.cleaner.referenceTracking.cleanCheckpoints."""
    gone = 0
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")
