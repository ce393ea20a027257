"""Incremental intake of stored snapshots with Structured Streaming.

The analytics themselves are batch; new snapshot folders can be followed as a file stream whose tables and
views are the batch ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heaplens.schema import schema


def follow(spark: SparkSession, root: str, table: str) -> DataFrame:
    """New files of a table in stores that are added below root, with the store's name as snapshot_id."""
    df = spark.readStream.schema(schema(table)).parquet(f"{root}/*/{table}")
    return df.withColumn("snapshot_id", F.element_at(F.split(F.input_file_name(), "/"), -3))


def type_sizes(native_objects: DataFrame) -> DataFrame:
    """Running sizes by snapshot and type, for an update-mode sink."""
    return native_objects.groupBy("snapshot_id", "native_type_name").agg(F.count("*").alias("obj_count"), F.sum("size_bytes").alias("total_bytes"))
