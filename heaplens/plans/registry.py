"""Named queries over the star-schema tables, each as a function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heaplens.catalog import Snapshot, from_star
from heaplens.operators import sweep
from heaplens.operators.residency import resident_of
from heaplens.plans import golden, multi, quality, reports, summary, views
from heaplens.plans.oracle import REGION


def _covering(t: Snapshot) -> DataFrame:
    return views.v_allocation_enriched(t, "nearest_covering").select("allocation_index", "system_region_index", "system_region_name").distinct()


def _downstream(t: Snapshot) -> DataFrame:
    return reports.downstream_stats(t, reports.leaked_a_top(t).select(F.col("native_object_index").cast("long").alias("root")))


def _flat(t: Snapshot) -> DataFrame:
    one = lambda df, source, idx, at: df.select(F.lit("").alias("snapshot_id"), F.lit(source).alias("source"), F.col(idx).cast("long").alias("idx"), F.col(at).alias("address"), F.col("size_bytes").alias("size"))
    owned = one(t.native_allocations, "allocation", "allocation_index", "address").unionByName(one(t.native_objects, "object", "native_object_index", "native_object_address"))
    regions = t.system_memory_regions.select(F.lit("").alias("snapshot_id"), F.col("region_index").cast("long").alias("idx"), "address")
    return sweep.flat_spans(regions, owned).drop("snapshot_id")


def _root_owned(t: Snapshot) -> DataFrame:
    roots = t.native_allocations.select(F.lit("allocation").alias("source"), F.col("allocation_index").cast("long").alias("idx"), F.col("root_reference_id").alias("root_id"))
    roots = roots.unionByName(t.native_objects.select(F.lit("object"), F.col("native_object_index").cast("long"), "root_reference_id").toDF("source", "idx", "root_id"))
    return _flat(t).join(roots, ["source", "idx"]).where("root_id >= 1").groupBy("root_id").agg(F.sum("size").alias("owned_bytes"))


def _page_residency(t: Snapshot) -> DataFrame:
    """Allocations against a bitmap in which two of three pages are resident."""
    ranges = t.native_allocations.where("size_bytes > 0").select("allocation_index", "address", F.col("size_bytes").alias("size"))
    last = ranges.agg(F.max((F.col("address") + F.col("size")) / 4096)).first()[0] or 0
    pages = t.spark.range(int(last) + 1).select(F.col("id").alias("page"), (F.col("id") % 3 != 0).alias("resident"))
    return resident_of(ranges, "allocation_index", pages, 4096).select("allocation_index", "resident_bytes")


def _summary(t: Snapshot) -> DataFrame:
    return summary.summary_metrics(summary.classified(t, sweep.nested_spans(summary.intervals(t))))


def _three(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt to three snapshots."""
    return df.withColumn("snapshot_id", (F.col(key) % 3).cast("string"))


def _multi_tracked(t: Snapshot) -> DataFrame:
    return multi.tracked(_three(t.native_objects, "native_object_index"), _three(t.native_roots, "root_index"))


def _multi_pivot(t: Snapshot) -> DataFrame:
    """Four snapshots with metrics of their own, one of which lacks a category; the eleventh place is none."""
    pairs = [(i, g, c) for i, (g, c) in enumerate(multi.PIVOT)]
    names = t.spark.createDataFrame(pairs, "place int, metric_group string, category string")
    r = t.system_memory_regions.select((F.col("region_index") % 4).alias("snap"), (F.floor(F.col("region_index") / 4) % 11).cast("int").alias("place"), "address", "size_bytes").where("snap < 3 or place <> 2")
    sums = r.groupBy("snap", "place").agg(F.max("address").alias("committed_bytes"), F.max("size_bytes").alias("resident_bytes"))
    metrics = sums.join(F.broadcast(names), "place", "left").withColumn("resident_available", F.when(F.col("place").isin(4, 5), 0).otherwise(1))  # ten names
    parts = {str(k): metrics.where(F.col("snap") == k).drop("snap", "place") for k in range(4)}
    return multi.pivoted(multi.unioned(parts))


def _sessions(t: Snapshot) -> DataFrame:
    """Names with and without a context, some that are no capture's, some with a GUID, some without a time."""
    i = F.col("region_index")
    text = lambda c: c.cast("string")
    name = F.concat(F.lit("Game_2026-05-1"), text(i % 10), F.lit("_10-28-3"), text(i % 6), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("_level_"), text(i % 2))), F.when(i % 7 == 0, F.concat(F.lit("#"), text(i))).otherwise(""))
    info = t.system_memory_regions.select(
        name.alias("snapshot_id"), F.when(i % 4 == 0, i % 8 + 1).otherwise(0).cast("long").alias("session_guid"), F.lit("").alias("product_name"), F.lit(None).cast("string").alias("platform"),
        F.lit(None).cast("string").alias("engine_version"), (16 + i % 2).alias("snap_format_version"), F.when(i % 5 != 0, F.date_format(F.timestamp_seconds("address"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("record_date_utc"),
    )
    return multi.sessions(multi.enriched(info))


QUERIES: dict[str, Callable[[Snapshot], DataFrame]] = {
    **reports.REPORTS,
    **views.VIEWS,
    "v_allocation_enriched_covering": _covering,
    "region_allocations": lambda t: views.region_allocations(t, REGION),
    "region_page_density": lambda t: views.region_page_density(t, REGION),
    "page_histogram": views.page_histogram,
    "bundle_mix": views.bundle_mix,
    "shared_assets": views.shared_assets,
    "downstream_stats": _downstream,
    "leak_ranking": reports.leak_ranking,
    "flat_sweep": _flat,
    "root_owned_bytes": _root_owned,
    "page_residency": _page_residency,
    "summary_sweep": _summary,
    "golden_assetbundle": golden.golden_assetbundle,
    "golden_serialized": golden.golden_serialized,
    "golden_remapper": golden.golden_remapper,
    "dq_duplicates": quality.duplicate_keys,
    "dq_orphans": quality.orphans,
    "multi_tracked": _multi_tracked,
    "multi_pivot": _multi_pivot,
    "session_groups": _sessions,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(from_star(spark, sf_dir))) for name, f in QUERIES.items()}
