"""Schemas of the stored snapshot tables, and their version."""

from __future__ import annotations

from pyspark.sql import types as T

#: Columns of the stored tables as name, type; `!` marks a column that is never null.
TABLES = {
    "schema_meta": "schema_version_major int!, schema_version_minor int!, tool_version string, created_at_utc string!",
    "snapshot_info": "snapshot_path string!, exported_at_utc string!, engine_version string, snap_format_version int, session_guid long, product_name string, platform string, record_date_utc string, page_size long",
    "native_objects": "native_object_index int!, instance_id string, name string, size_bytes long!, native_object_address long!, root_reference_id long!, type_index int, native_type_name string, is_destroyed boolean!, resident_size_bytes long",
    "managed_objects": "managed_object_index int!, address long!, size_bytes long!, type_index int, managed_type_name string, native_object_index long",
    "connections": "from_kind string!, from_index long!, to_kind string!, to_index long!, connection_type string!",
    "native_roots": "root_index int!, root_id long!, area_name string, object_name string, accumulated_size_bytes long!, resident_size_bytes long",
    "memory_regions": "region_index int!, address_base long!, address_size long!, name string, parent_region_index int, first_allocation_index int, num_allocations int!",
    "native_allocations": "allocation_index int!, address long!, size_bytes long!, overhead_size_bytes long!, padding_size_bytes long!, memory_region_index int, root_reference_id long",
    "system_memory_regions": "region_index int!, address long!, size_bytes long!, resident_bytes long!, type int!, name string",
    "summary_metrics": "metric_group string!, category string!, committed_bytes long!, resident_bytes long!, resident_available int!",
}
#: The version of these schemas; a new major changes tables, a new minor views only.
VERSION = (1, 3)
#: What each minor version of the current major brought.
CHANGES = {(1, 0): "tables", (1, 1): "summary metrics", (1, 2): "bundle utilisation view", (1, 3): "loaded assets view"}

_KINDS = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType()}


def schema(table: str) -> T.StructType:
    fields = [x.split() for x in TABLES[table].split(", ")]
    return T.StructType([T.StructField(n, _KINDS[k.rstrip("!")], not k.endswith("!")) for n, k in fields])


def evaluate(major: int, minor: int) -> str:
    """What a store of this version needs: none, upgrade_in_place, re_export or tool_outdated."""
    if (major, minor) == VERSION:
        return "none"
    if major != VERSION[0]:
        return "re_export" if major < VERSION[0] else "tool_outdated"
    return "upgrade_in_place" if minor < VERSION[1] else "tool_outdated"


def changes_since(major: int, minor: int) -> list[tuple[tuple[int, int], str]]:
    """The versions after this one, with what they brought."""
    return [(v, what) for v, what in sorted(CHANGES.items()) if v > (major, minor)]


def describe(major: int, minor: int) -> str:
    status = {"none": "current", "upgrade_in_place": "older, can be upgraded in place", "re_export": "too old, export again", "tool_outdated": "newer than this tool"}
    return f"{major}.{minor} ({status[evaluate(major, minor)]})"
