"""Comparison of a snapshot with golden values."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heaplens.catalog import Snapshot

#: Tolerances as least bytes and part of the larger magnitude.
EXACT_COMMITTED, ESTIMATED, RESIDENT = (64 << 10, 0.01), (1 << 20, 0.05), (64 << 10, 0.01)
#: Categories whose committed bytes are estimates.
ESTIMATES = ("Graphics (Estimated)", "Untracked")


def _sums(df: DataFrame, size: str, *by: str) -> DataFrame:
    cols = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in (("allocated_bytes", size), ("resident_bytes", "resident_size_bytes"))]
    return df.groupBy(*by).agg(*cols) if by else df.agg(F.count("*").alias("obj_count"), *cols)


def golden_assetbundle(t: Snapshot) -> DataFrame:
    return _sums(t.native_objects.where("native_type_name = 'AssetBundle' and not is_destroyed"), "size_bytes")


def golden_serialized(t: Snapshot) -> DataFrame:
    return _sums(t.native_roots.where(F.contains(F.lower(F.coalesce("area_name", F.lit(""))), F.lit("serializedfile"))), "accumulated_size_bytes")


def remapper_rows(native_roots: DataFrame) -> DataFrame:
    both = F.concat(F.coalesce("area_name", F.lit("")), F.lit(":"), F.coalesce("object_name", F.lit("")))
    return native_roots.where(F.col("object_name").like("%Remapper%") | both.like("%PersistentManager%Remapper%"))


def golden_remapper(t: Snapshot) -> DataFrame:
    return _sums(remapper_rows(t.native_roots), "accumulated_size_bytes", "area_name", "object_name")


def within(a: int, b: int, tolerance: tuple[int, float]) -> bool:
    """At most the least bytes, or the part of the larger magnitude, apart."""
    return abs(a - b) <= max(tolerance[0], int(max(abs(a), abs(b)) * tolerance[1]))


def compare(t: Snapshot, golden: dict) -> list[str]:
    """What differs: counts and allocated bytes must be equal, resident and summary bytes near."""
    golden = {k.lower(): v for k, v in golden.items()}
    field = lambda d, k: {x.lower(): v for x, v in d.items()}.get(k.lower())
    out: list[str] = []

    def exact(name: str, want, have) -> None:
        if (want or 0) != (have or 0):
            out.append(f"{name}: expected {want}, got {have}")

    def near(name: str, want, have, tolerance) -> None:
        if not within(int(want or 0), int(have or 0), tolerance):
            out.append(f"{name}: expected {want}, got {have}")

    for m in golden.get("nativetypemetrics") or []:
        name = field(m, "NativeTypeName")
        row = {"AssetBundle": golden_assetbundle, "SerializedFile": golden_serialized}.get(name)
        if row is None:
            continue
        r = row(t).first()
        exact(f"{name}.Count", field(m, "Count"), r.obj_count)
        exact(f"{name}.Allocated", field(m, "AllocatedBytes"), r.allocated_bytes)
        near(f"{name}.Resident", field(m, "ResidentBytes"), r.resident_bytes, RESIDENT)
    roots = golden.get("nativerootmetrics") or []
    if roots:
        have = {(r.area_name or "", r.object_name or ""): r for r in golden_remapper(t).collect()}
        for m in roots:
            key = (field(m, "AreaName") or "", field(m, "ObjectName") or "")
            r = have.get(key)
            if r is None:
                out.append(f"{':'.join(key)}: missing")
                continue
            exact(f"{':'.join(key)}.Allocated", field(m, "AllocatedBytes"), r.allocated_bytes)
            near(f"{':'.join(key)}.Resident", field(m, "ResidentBytes"), r.resident_bytes, RESIDENT)
    rows = {(r.metric_group, r.category): r for r in t.summary_metrics.collect()}
    groups = {g: golden.get(g.lower()) or [] for g in ("AllocatedMemoryDistribution", "ManagedHeapUtilization")}
    if any(groups.values()):
        total = rows.get(("Totals", "Total"))
        near("Summary[Totals].Allocated", golden.get("totalallocatedbytes"), total and total.committed_bytes, EXACT_COMMITTED)
        near("Summary[Totals].Resident", golden.get("totalresidentbytes"), total and total.resident_bytes, RESIDENT)
    for group, metrics in groups.items():
        for m in metrics:
            name = field(m, "Name").rstrip("*")
            r = rows.get((group, name))
            if r is None:
                out.append(f"Summary[{group}].{name}: missing")
                continue
            near(f"Summary[{group}].{name}.Committed", field(m, "CommittedBytes"), r.committed_bytes, ESTIMATED if name in ESTIMATES else EXACT_COMMITTED)
            if field(m, "ResidentAvailable") and r.resident_available:
                near(f"Summary[{group}].{name}.Resident", field(m, "ResidentBytes"), r.resident_bytes, RESIDENT)
    return out


def result_json(golden: dict, golden_path: str, database: str, failures: list[str]) -> str:
    return json.dumps({"SnapshotName": golden.get("SnapshotName"), "GoldenPath": golden_path, "DatabasePath": database, "ValidatedAtUtc": datetime.now(UTC).isoformat(), "Passed": not failures, "Failures": failures}, indent=2)
