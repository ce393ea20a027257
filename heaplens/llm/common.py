"""Shared-folder scratch tables and small helpers used by the corpus operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only when the session names no spark.checkpoint.dir (single-machine tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, else a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = LOCAL_CHECKPOINTS
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of the application: no result may be read after that."""
    removed(spark, f"{shared_folder(spark)}/heaplens-{spark.sparkContext.applicationId}")


def _clear_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # else the session was stopped before
        clear(spark)


#: Applications whose scratch tables go when the driver ends.
_ENDING: set[str] = set()


class Scratch:
    """Parquet tables of one operator run under the shared folder.

    Spark's committed writes make each table complete whatever executors are lost. Operators drop what
    later steps don't read. Tables that a returned DataFrame still reads stay until its reader calls
    ``clear``, or until the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, app = spark, spark.sparkContext.applicationId
        self.base = f"{shared_folder(spark)}/heaplens-{app}/{name}-{uuid.uuid4().hex}"
        if app not in _ENDING:
            _ENDING.add(app)
            atexit.register(_clear_at_exit, spark)

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the named tables, or everything."""
        for path in [f"{self.base}/{n}" for n in names] or [self.base]:
            removed(self.spark, path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint of a small table: cuts lineage and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """The same by a table that is written and read again, for loops of many rounds.

    A checkpointed frame brings its constraints along, which grow with each round and make planning its largest part.
    """
    return Scratch(df.sparkSession, "small").table(df, "rows")


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder that the driver and the executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "hdfs:")) else f"file://{uri}")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out():
    """True for documents that no model of this package may learn from: crc32(doc_id as text) mod 3 is 1."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Of each operator with caches in the Python workers: how to drop them.
HOLDERS: dict = {}


def only(name: str) -> None:
    """Called where an operator begins work in a Python worker: drop what other operators left there."""
    others = [drop for held, drop in HOLDERS.items() if held != name]
    for drop in others:
        drop()
    if others:
        release()


def release() -> None:
    """Give freed memory back to the system, for workers are kept for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        pass
