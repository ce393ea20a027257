"""Summary metrics of a snapshot from the nested sweep's spans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heaplens.catalog import Snapshot
from heaplens.operators import sweep as S

#: Names of the roots that hold a managed runtime's own memory.
VM_ROOTS = ("Mono VM", "IL2CPP VM", "IL2CPPMemoryAllocator")
#: System regions that are sent to all executors; more are shuffled, and the spans with them.
BROADCAST = 1_000_000
#: Groups and categories of the result.
TOTALS, DISTRIBUTION, HEAP_USE = "Totals", "AllocatedMemoryDistribution", "ManagedHeapUtilization"
CATEGORIES = ("Native", "Managed", "Executables & Mapped", "Graphics (Estimated)", "Untracked", "Android Runtime")


@dataclass(frozen=True)
class TargetStats:
    """What the device reported of itself, where a capture has it."""

    graphics_used: int
    total_virtual: int = 0


def intervals(t: Snapshot, heap_sections: DataFrame | None = None, snapshot_id: str = "") -> DataFrame:
    """snapshot_id, kind, idx, address, size of all memory that the tables know of."""
    one = lambda df, kind, idx, at, size: df.select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(kind).alias("kind"), F.col(idx).cast("long").alias("idx"), F.col(at).alias("address"), F.col(size).alias("size"))
    native = t.memory_regions.where("address_base <> 0").where(~F.coalesce(F.contains("name", F.lit("Virtual Memory")), F.lit(False)))
    out = one(t.system_memory_regions, S.SYSTEM, "region_index", "address", "size_bytes")
    out = out.unionByName(one(native, S.NATIVE, "region_index", "address_base", "address_size"))
    out = out.unionByName(one(t.native_allocations, S.ALLOCATION, "allocation_index", "address", "size_bytes"))
    out = out.unionByName(one(t.native_objects, S.OBJECT, "native_object_index", "native_object_address", "size_bytes"))
    out = out.unionByName(one(t.managed_objects, S.MANAGED, "managed_object_index", "address", "size_bytes"))
    if heap_sections is not None:
        out = out.unionByName(one(heap_sections, S.HEAP, "section_index", "address", "size_bytes"))
    return out


def point_type(android: bool) -> Column:
    """The category of a span by its kind, its system region's type and name, and its heap section's kind."""
    name = F.coalesce("region_name", F.lit(""))
    device = F.col("region_type") == 3
    out = F.when(F.col("kind").isin(S.NATIVE, S.ALLOCATION, S.OBJECT), "Native").when(F.col("kind").isin(S.HEAP, S.MANAGED), "Managed")
    if android:
        out = out.when(name.startswith("[anon:dalvik-") | name.startswith("/dev/ashmem/dalvik-"), "Android Runtime").when(name.startswith("/dev/"), "Graphics (Estimated)")
    return out.when(device, "Graphics (Estimated)").when(F.col("region_type") == 1, "Executables & Mapped").otherwise("Untracked")


def classified(t: Snapshot, spans: DataFrame, heap_sections: DataFrame | None = None, android: bool = False) -> DataFrame:
    """Spans with category and heap part, and whether the runtime's own root holds them.

    Where there are system regions, spans outside all of them are left out.
    """
    regions = t.system_memory_regions.select(F.col("region_index").cast("long").alias("idx"), F.lit(S.SYSTEM).alias("kind"), F.col("type").alias("region_type"), F.col("name").alias("region_name"))
    few = regions.limit(BROADCAST + 1).count() <= BROADCAST
    out = spans.join(F.broadcast(regions) if few else regions, ["kind", "idx"], "left")
    if not t.system_memory_regions.isEmpty():
        out = out.where("region >= 0")
    if heap_sections is not None:
        out = out.join(heap_sections.select(F.col("section_index").cast("long").alias("idx"), F.lit(S.HEAP).alias("kind"), "is_vm"), ["kind", "idx"], "left")
    else:
        out = out.withColumn("is_vm", F.lit(None).cast("boolean"))
    vm = t.native_roots.where(F.col("object_name").isin(*VM_ROOTS)).orderBy("root_index").select("root_id").first()
    if vm is None or vm.root_id is None:
        out = out.withColumn("in_vm", F.lit(False))
    else:
        rooted = t.native_allocations.select(F.lit(S.ALLOCATION).alias("kind"), F.col("allocation_index").cast("long").alias("idx"), F.col("root_reference_id").alias("root"))
        rooted = rooted.unionByName(t.native_objects.select(F.lit(S.OBJECT).alias("kind"), F.col("native_object_index").cast("long").alias("idx"), F.col("root_reference_id").alias("root")))
        held = rooted.where(F.col("root") == vm.root_id).select("kind", "idx", F.lit(True).alias("in_vm"))
        out = out.join(held, ["kind", "idx"], "left")
    part = F.when((F.col("kind") == S.HEAP) & F.coalesce("is_vm", F.lit(False)), "Virtual Machine").when(F.col("kind") == S.HEAP, "Empty Heap Space").when(F.col("kind") == S.MANAGED, "Objects")
    return out.withColumns({"category": point_type(android), "heap_part": part, "in_vm": F.coalesce("in_vm", F.lit(False))})


def summary_metrics(spans: DataFrame, has_regions: bool = True, stats: TargetStats | None = None) -> DataFrame:
    """The summary_metrics rows of classified spans (with resident, where known)."""
    resident = F.col("resident") if "resident" in spans.columns else F.lit(0).cast("long")
    s = spans.withColumn("resident", resident)
    total = lambda test: [F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).cast("long") for c in ("size", "resident")]
    wanted = {c: F.col("category") == c for c in CATEGORIES} | {c: F.col("heap_part") == c for c in ("Virtual Machine", "Objects", "Empty Heap Space")} | {"vm root": F.col("in_vm")}
    sums = s.agg(*[x.alias(f"{c}/{k}") for c, test in wanted.items() for k, x in enumerate(total(test))]).first()
    got = {c: [sums[f"{c}/0"], sums[f"{c}/1"]] for c in wanted}
    whole = [sum(got[c][k] for c in CATEGORIES) for k in (0, 1)]
    graphics, untracked = got["Graphics (Estimated)"], got["Untracked"]
    if stats:
        if not has_regions and stats.total_virtual > 0:
            untracked[:] = [max(0, stats.total_virtual - whole[0]), 0]
            whole = [stats.total_virtual, 0]
        # Graphics memory is what the device says; the difference comes from or goes to what is untracked.
        moved = min(stats.graphics_used - graphics[0], untracked[0]) if graphics[0] < stats.graphics_used else stats.graphics_used - graphics[0]
        graphics[:], untracked[:] = [graphics[0] + moved, 0], [untracked[0] - moved, 0]
    vm, native, managed = got["vm root"], got["Native"], got["Managed"]
    for k in (0, 1):
        managed[k] += vm[k]
        native[k] -= min(native[k], vm[k])
        got["Virtual Machine"][k] += vm[k]
    rows = [(TOTALS, "Total", *whole, 1)]
    for c in CATEGORIES:
        if c != "Android Runtime" or got[c][0] > 0:
            known = c not in ("Graphics (Estimated)", "Untracked")
            rows.append((DISTRIBUTION, c, got[c][0], got[c][1] if known else 0, int(known)))
    rows += [(HEAP_USE, c, *got[c], 1) for c in ("Virtual Machine", "Objects", "Empty Heap Space")]
    return spans.sparkSession.createDataFrame(rows, "metric_group string, category string, committed_bytes long, resident_bytes long, resident_available int")
