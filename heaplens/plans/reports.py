"""The fixed report queries over a snapshot. Every ranking has a unique last key, so limits are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heaplens.catalog import Snapshot
from heaplens.functions.numeric import mb, named, pct, rounded
from heaplens.operators.graph import exclusive, reachable
from heaplens.plans.views import native_edges

UNKNOWN, UNNAMED = "(unknown)", "(unnamed)"


def _one(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def _mean(c: str) -> Column:
    return F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0))


def snapshot_info(t: Snapshot) -> DataFrame:
    return t.snapshot_info.select("snapshot_path", "exported_at_utc", "engine_version")


def schema_meta(t: Snapshot) -> DataFrame:
    return t.schema_meta.select("schema_version_major", "schema_version_minor").limit(1)


def table_counts(t: Snapshot) -> DataFrame:
    names = ("native_objects", "managed_objects", "connections", "native_roots", "memory_regions", "native_allocations")
    parts = [getattr(t, n).agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("table_name")


def native_overview(t: Snapshot) -> DataFrame:
    total = F.sum("size_bytes")
    return t.native_objects.agg(
        F.count("*").alias("total_objects"), mb(total).alias("total_native_mb"), rounded(total / F.lit(1024.0**3), 3).alias("total_native_gb"),
        rounded(_mean("size_bytes") / 1024.0, 2).alias("avg_size_kb"), mb(F.max("size_bytes")).alias("max_single_object_mb"), F.countDistinct("native_type_name").alias("distinct_types"),
    )


def _by_type(df: DataFrame, c: str) -> DataFrame:
    """The 40 largest types; the share is of all objects, from one row per type."""
    g = df.groupBy(c).agg(F.count("*").alias("obj_count"), F.sum("size_bytes").alias("bytes"))
    all_ = F.sum("bytes").over(Window.partitionBy())
    return g.select(named(c, UNKNOWN).alias("type_name"), "obj_count", mb(F.col("bytes")).alias("total_mb"), pct(F.col("bytes"), all_, 2).alias("pct_of_total")).orderBy(F.desc("total_mb"), "type_name").limit(40)


def native_types(t: Snapshot) -> DataFrame:
    return _by_type(t.native_objects, "native_type_name")


def managed_types(t: Snapshot) -> DataFrame:
    return _by_type(t.managed_objects, "managed_type_name")


def size_buckets(t: Snapshot) -> DataFrame:
    bucket = F.floor(F.log(4.0, F.col("size_bytes").cast("double"))).cast("int")
    g = t.native_objects.where("size_bytes > 0").groupBy(bucket.alias("log4_bucket")).agg(F.count("*").alias("obj_count"), F.sum("size_bytes").alias("bytes"))
    return g.select("log4_bucket", mb(F.pow(F.lit(4.0), F.col("log4_bucket")), 3).alias("bucket_floor_mb"), "obj_count", mb(F.col("bytes")).alias("total_mb")).orderBy(F.desc("log4_bucket"))


def top_native(t: Snapshot) -> DataFrame:
    top = t.native_objects.orderBy(F.desc("size_bytes"), "native_object_index").limit(50)
    return top.select("native_object_index", named("name", UNNAMED).alias("name"), named("native_type_name", UNKNOWN).alias("type_name"), mb(F.col("size_bytes"), 3).alias("size_mb"))


def top5_pct(t: Snapshot) -> DataFrame:
    """Sum of the rounded shares of the five largest types."""
    g = t.native_objects.groupBy("native_type_name").agg(F.sum("size_bytes").alias("bytes"))
    share = g.withColumn("pct", pct(F.col("bytes"), F.sum("bytes").over(Window.partitionBy()), 2))
    return share.orderBy(F.desc("bytes"), F.asc_nulls_last("native_type_name")).limit(5).agg(rounded(F.sum("pct"), 1).alias("top5_pct"))


def _duplicates(t: Snapshot, empty_as_null: bool = False) -> DataFrame:
    o = t.native_objects
    o = o.withColumn("name", F.nullif("name", F.lit(""))) if empty_as_null else o
    g = o.where("name is not null").groupBy("name", "native_type_name").agg(F.count("*").alias("n"), F.min("size_bytes").alias("low"), F.max("size_bytes").alias("high"), F.sum("size_bytes").alias("bytes"))
    return g.where("n > 1").withColumn("wasted", (F.col("n") - 1) * (F.col("bytes").cast("double") / F.col("n")))


def duplicates(t: Snapshot, empty_as_null: bool = False) -> DataFrame:
    return _duplicates(t, empty_as_null).select(
        "name", named("native_type_name", UNKNOWN).alias("type_name"), F.col("n").alias("duplicate_count"), mb(F.col("low"), 3).alias("min_size_mb"), mb(F.col("high"), 3).alias("max_size_mb"),
        mb(F.col("bytes"), 3).alias("total_mb"), mb(F.col("wasted"), 3).alias("wasted_mb"),
    ).orderBy(F.desc("wasted_mb"), "name", "type_name").limit(50)


def _native_total(t: Snapshot) -> Column:
    return t.native_objects.agg(F.sum("size_bytes")).scalar()


def duplicate_summary(t: Snapshot) -> DataFrame:
    return _duplicates(t).agg(F.count("*").alias("duplicate_groups"), (F.sum("n") - F.count("*")).alias("extra_instances"), mb(F.sum("wasted")).alias("total_wasted_mb"), pct(F.sum("wasted"), _native_total(t)).alias("pct_of_native_total"))


def managed_overview(t: Snapshot) -> DataFrame:
    return t.managed_objects.agg(
        F.count("*").alias("total_objects"), mb(F.sum("size_bytes")).alias("total_managed_mb"), rounded(_mean("size_bytes"), 0).alias("avg_size_bytes"),
        F.countDistinct("managed_type_name").alias("distinct_types"), F.count("native_object_index").alias("objects_with_native_ref"),
    )


def roots_by_area(t: Snapshot) -> DataFrame:
    g = t.native_roots.groupBy("area_name").agg(F.count("*").alias("root_count"), mb(F.sum("accumulated_size_bytes")).alias("total_accumulated_mb"))
    return g.select(named("area_name", UNKNOWN).alias("area_name"), "root_count", "total_accumulated_mb").orderBy(F.desc("total_accumulated_mb"), "area_name")


def roots_top(t: Snapshot) -> DataFrame:
    top = t.native_roots.orderBy(F.desc("accumulated_size_bytes"), "root_id").limit(30)
    return top.select("root_id", named("area_name", UNKNOWN).alias("area_name"), named("object_name", UNNAMED).alias("object_name"), mb(F.col("accumulated_size_bytes"), 3).alias("accumulated_mb"))


def top50_summary(t: Snapshot) -> DataFrame:
    top = t.native_objects.select("size_bytes").orderBy(F.desc("size_bytes")).limit(50)
    return top.agg(F.count("*").alias("obj_count"), mb(F.sum("size_bytes")).alias("total_mb"), pct(F.sum("size_bytes"), _native_total(t)).alias("pct_of_native_total"))


def conn_types(t: Snapshot) -> DataFrame:
    return t.connections.groupBy("connection_type").agg(F.count("*").alias("edge_count")).orderBy(F.desc("edge_count"), "connection_type")


def _degree(t: Snapshot, side: str, name: str, objects: DataFrame | None = None) -> DataFrame:
    """The 20 objects with most edges on one side: counts first, so only one row per object is joined."""
    n = t.connections.where(F.col(f"{side}_kind") == "native_object").groupBy(F.col(f"{side}_index").alias("native_object_index")).agg(F.count("*").alias(name))
    o = (objects if objects is not None else t.native_objects).withColumn("native_object_index", F.col("native_object_index").cast("long"))
    top = n.join(o, "native_object_index").orderBy(F.desc(name), "native_object_index").limit(20)
    return top.select(F.col("native_object_index").cast("int").alias("native_object_index"), named("name", UNNAMED).alias("name"), named("native_type_name", UNKNOWN).alias("type_name"), mb(F.col("size_bytes")).alias("size_mb"), name)


def most_referenced(t: Snapshot) -> DataFrame:
    return _degree(t, "to", "inbound_refs")


def most_referenced_excl(t: Snapshot) -> DataFrame:
    """Without script assets, and without objects of unknown type."""
    return _degree(t, "to", "inbound_refs", t.native_objects.where("native_type_name <> 'MonoScript'"))


def most_outbound(t: Snapshot) -> DataFrame:
    return _degree(t, "from", "outbound_refs")


def region_parents(t: Snapshot) -> DataFrame:
    parent = t.memory_regions.select(F.col("region_index").alias("parent_region_index"), F.col("name").alias("parent"))
    top = t.memory_regions.join(parent, "parent_region_index", "left").orderBy(F.desc("address_size"), "region_index").limit(40)
    return top.select("region_index", named("name", UNNAMED).alias("region_name"), named("parent", "—").alias("parent_name"), mb(F.col("address_size")).alias("size_mb"), "num_allocations")


def alloc_efficiency(t: Snapshot) -> DataFrame:
    kinds = {"payload": "size_bytes", "overhead": "overhead_size_bytes", "padding": "padding_size_bytes"}
    sums = t.native_allocations.groupBy(F.col("memory_region_index").alias("region_index")).agg(*[F.sum(c).alias(k) for k, c in kinds.items()])
    r = t.memory_regions.join(sums, "region_index").where("payload is not null")
    out = r.select(
        "region_index", named("name", UNNAMED).alias("region_name"), "num_allocations", mb(F.col("address_size")).alias("region_size_mb"), *[mb(F.col(k)).alias(f"{k}_mb") for k in kinds],
        pct(F.col("payload"), F.col("address_size")).alias("utilization_pct"),
    )
    return out.orderBy(F.desc_nulls_last("payload_mb"), "region_index").limit(30).drop("region_index")


def _destroyed_pairs(t: Snapshot) -> DataFrame:
    """Wrappers of native objects that are destroyed but still in memory."""
    o = t.native_objects.where("is_destroyed").select(F.col("native_object_index").cast("long").alias("native_object_index"), "name", "native_type_name", "size_bytes")
    return t.managed_objects.select("managed_object_index", "managed_type_name", "native_object_index").join(o, "native_object_index")


def _orphans(t: Snapshot) -> DataFrame:
    """Wrappers without a native object, of types of which others have one."""
    m = t.managed_objects.select("managed_type_name", "native_object_index")
    return m.where("native_object_index is null").join(m.where("native_object_index is not null").select("managed_type_name").distinct(), "managed_type_name", "left_semi")


def leaked_a_stats(t: Snapshot) -> DataFrame:
    return _destroyed_pairs(t).agg(F.count("*").alias("total_leaked_count"), mb(F.sum("size_bytes")).alias("native_mb_retained"), pct(F.sum("size_bytes"), _native_total(t)).alias("pct_of_native_total"))


def leaked_a_types(t: Snapshot) -> DataFrame:
    g = _destroyed_pairs(t).groupBy(named("native_type_name", UNKNOWN).alias("native_type"), named("managed_type_name", UNKNOWN).alias("managed_type"))
    return g.agg(F.count("*").alias("leaked_count"), mb(F.sum("size_bytes")).alias("native_mb_retained")).orderBy(F.desc("native_mb_retained"), "native_type", "managed_type")


def leaked_a_top(t: Snapshot) -> DataFrame:
    top = _destroyed_pairs(t).orderBy(F.desc("size_bytes"), "native_object_index", "managed_object_index").limit(20)
    return top.select(F.col("native_object_index").cast("int").alias("native_object_index"), named("name", UNNAMED).alias("name"), named("native_type_name", UNKNOWN).alias("native_type"), named("managed_type_name", UNKNOWN).alias("managed_type"), mb(F.col("size_bytes")).alias("own_size_mb"))


def leaked_b_types(t: Snapshot) -> DataFrame:
    return _orphans(t).groupBy(named("managed_type_name", UNKNOWN).alias("managed_type")).agg(F.count("*").alias("leaked_count")).orderBy(F.desc("leaked_count"), "managed_type")


def leaked_b_stats(t: Snapshot) -> DataFrame:
    return _orphans(t).agg(F.count("*").alias("total_orphaned"))


def leaked_combined(t: Snapshot) -> DataFrame:
    freed = F.lit("unknown (freed)")
    a = _destroyed_pairs(t).groupBy("native_type_name", "managed_type_name").agg(F.count("*").alias("leaked_count"), mb(F.sum("size_bytes")).alias("native_mb_retained"))
    b = _orphans(t).groupBy("managed_type_name").agg(F.count("*").alias("leaked_count"))
    cols = "pattern", "native_type_name", "managed_type_name", "leaked_count", "native_mb_retained"
    a = a.withColumns({"pattern": F.lit("A: Destroyed (native still in memory)"), "native_type_name": F.coalesce("native_type_name", freed)}).select(*cols)
    b = b.withColumns({"pattern": F.lit("B: Orphaned (native freed)"), "native_type_name": freed, "native_mb_retained": F.lit(0.0)}).select(*cols)
    return a.unionByName(b).orderBy(F.desc("leaked_count"), *cols[:3])


def destroyed_types(t: Snapshot) -> DataFrame:
    g = t.native_objects.where("is_destroyed").groupBy(named("native_type_name", UNKNOWN).alias("native_type"))
    return g.agg(F.count("*").alias("destroyed_count"), mb(F.sum("size_bytes")).alias("native_mb_retained")).orderBy(F.desc("native_mb_retained"), "native_type")


def destroyed_stats(t: Snapshot) -> DataFrame:
    return t.native_objects.where("is_destroyed").agg(F.count("*").alias("total_destroyed"), mb(F.sum("size_bytes")).alias("native_mb_retained"), pct(F.sum("size_bytes"), _native_total(t)).alias("pct_of_native_total"))


def object_categories(t: Snapshot, limit: int | None = None) -> DataFrame:
    """Live objects by type, unnamed types together."""
    name = F.coalesce(F.nullif("native_type_name", F.lit("")), F.lit(UNKNOWN))
    g = t.native_objects.where("not is_destroyed").groupBy(name.alias("type_name")).agg(F.sum("size_bytes").alias("total_bytes"), F.count("*").alias("obj_count")).orderBy(F.desc("total_bytes"), "type_name")
    return g.limit(limit) if limit else g


def downstream_stats(t: Snapshot, roots: DataFrame) -> DataFrame:
    """root, downstream_mb, exclusive_mb of all roots (root) in one frontier loop."""
    edges = native_edges(t)
    reach = reachable(edges, roots)
    size = t.native_objects.select(F.col("native_object_index").cast("long").alias("node"), "size_bytes")
    total = lambda nodes, name: nodes.join(size, "node").groupBy("root").agg(mb(F.sum("size_bytes")).alias(name))
    out = roots.distinct().join(total(reach, "downstream_mb"), "root", "left").join(total(exclusive(edges, reach), "exclusive_mb"), "root", "left")
    return out.select("root", _one(F.col("downstream_mb")).alias("downstream_mb"), _one(F.col("exclusive_mb")).alias("exclusive_mb"))


def leak_ranking(t: Snapshot) -> DataFrame:
    """The largest leaked objects with what they keep alive, by what freeing them would free."""
    top = leaked_a_top(t).withColumn("root", F.col("native_object_index").cast("long"))
    stats = downstream_stats(t, top.select("root"))
    freed = F.bround(F.col("own_size_mb") + F.col("exclusive_mb"), 2).alias("total_freed_mb")
    return top.join(stats, "root").drop("root").select("*", freed).orderBy(F.desc("total_freed_mb"), "native_object_index", "managed_type")


REPORTS = {
    f.__name__: f
    for f in (
        table_counts, native_overview, native_types, size_buckets, top_native, top5_pct, duplicates, duplicate_summary, managed_overview, managed_types, roots_by_area, roots_top,
        top50_summary, conn_types, most_referenced, most_referenced_excl, most_outbound, region_parents, alloc_efficiency, leaked_a_stats, leaked_a_types, leaked_a_top, leaked_b_types,
        leaked_b_stats, leaked_combined, destroyed_types, destroyed_stats, object_categories,
    )
}
