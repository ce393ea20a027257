"""Stored snapshots: Parquet tables with a version, skip-existing, in-place upgrade."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heaplens.catalog import Snapshot
from heaplens.schema import TABLES, VERSION, evaluate, schema


def write(t: Snapshot, folder: str) -> None:
    """Replace a store's tables. Large ones are sorted by address within files, for row-group statistics."""
    for name, df in t.tables.items():
        at = next((c for c in ("address", "native_object_address", "address_base") if c in df.columns), None)
        (df.sortWithinPartitions(at) if at else df).write.mode("overwrite").parquet(f"{folder}/{name}")
    set_version(t.spark, folder, *VERSION)


def set_version(spark: SparkSession, folder: str, major: int, minor: int) -> None:
    row = [(major, minor, None, datetime.now(UTC).isoformat())]
    spark.createDataFrame(row, schema("schema_meta")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/schema_meta")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def modified(spark: SparkSession, path: str) -> int:
    """Milliseconds of a path's last change, -1 if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(fs.getFileStatus(p).getModificationTime()) if fs.exists(p) else -1


def up_to_date(spark: SparkSession, source: str, folder: str) -> bool:
    """The store is no older than its source."""
    there = modified(spark, f"{folder}/schema_meta")
    return there >= 0 and there >= modified(spark, source)


def read(spark: SparkSession, folder: str) -> Snapshot:
    """The tables that are there; columns that an older store lacks are null."""
    tables = {}
    for name in TABLES:
        if exists(spark, f"{folder}/{name}"):
            tables[name] = drifted(spark.read.parquet(f"{folder}/{name}"), name)
    return Snapshot(spark, tables)


def discover(spark: SparkSession, folder: str, name_filter: str = "") -> list[str]:
    """The folder itself if it is a store, else the stores directly in it whose names hold the filter, by name."""
    folder = folder.rstrip("/")
    if any(exists(spark, f"{folder}/{t}") for t in TABLES) or not exists(spark, folder):
        return [folder]
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [x.getPath().getName() for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if x.isDirectory()]
    names = [n for n in names if name_filter.lower() in n.lower() and not n.startswith(("_", ".")) and any(exists(spark, f"{folder}/{n}/{t}") for t in TABLES)]
    return [f"{folder}/{n}" for n in sorted(names, key=str.lower)]


def drifted(df: DataFrame, table: str) -> DataFrame:
    missing = [f for f in schema(table).fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def version_of(t: Snapshot) -> tuple[int, int]:
    """(0, 0) for a store without a version."""
    row = t.schema_meta.first()
    return (row.schema_version_major, row.schema_version_minor) if row else (0, 0)


def upgrade(spark: SparkSession, folder: str) -> str:
    """Bring a store of an older minor version up to date; what was found needed."""
    status = evaluate(*version_of(read(spark, folder)))
    if status == "upgrade_in_place":
        set_version(spark, folder, *VERSION)
    return status
