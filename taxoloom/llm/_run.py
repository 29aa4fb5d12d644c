"""Session helpers: worker import path, written intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bound of an Arrow batch on its way to Python, unless the session sets its own: records alone don't bound
#: the memory of a worker and of Spark's buffers where texts are long.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package when only the driver's sys.path holds it; bound Arrow batches by bytes."""
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    env = spark.sparkContext.environment
    parts = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def give_back() -> None:
    """Return what this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def lean(run, pause: float = 1.0):
    """``run`` for mapInArrow, giving memory back at most every ``pause`` seconds and at the end.

    A worker serves many tasks of many stages; what one has freed shouldn't stand beside what the next one takes.
    """

    def lean_run(batches):
        at = time.monotonic()
        try:
            for out in run(batches):
                yield out
                del out
                if time.monotonic() - at > pause:
                    give_back()
                    at = time.monotonic()
        finally:
            give_back()

    return lean_run


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own only where that is unset in local mode, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="taxoloom-")
        spark.sparkContext.setCheckpointDir(root)
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root.rstrip("/")


class Written:
    """A table written to the shared folder; cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.spark = spark
        self.path = f"{shared_folder(spark)}/taxoloom/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        jvm = spark._jvm
        jvm.System.gc()  # lets Spark's cleaner remove the shuffle files behind this table

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> Written:
    return Written(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
