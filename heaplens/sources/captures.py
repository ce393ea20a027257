"""Captures as snapshot tables: one task decodes a file, and its rows of all tables are written once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from heaplens.catalog import Snapshot
from heaplens.operators.residency import resident_ranges
from heaplens.schema import TABLES, VERSION, schema
from heaplens.sources import snap as S
from heaplens.sources.crawl import Heap

#: Tables that come from a file.
EXTRACTED = ("schema_meta", "snapshot_info", "native_objects", "managed_objects", "connections", "native_roots", "memory_regions", "native_allocations", "system_memory_regions")
#: Tables that only the summary and the checks use; they are not stored.
EXTRA = {
    "heap_sections": "section_index int, address long, size_bytes long, is_vm boolean",
    "page_runs": "region long, low long, high long, start long, size long",
    "target_stats": "total_virtual long, graphics_used long",
    "row_counts": "table_name string, rows long",
}


def _signed(x) -> int:
    """Unsigned addresses and sizes are stored as the signed integer of the same bits."""
    return int(np.uint64(x).astype(np.int64))


def utc_of(ticks: int) -> str | None:
    """ISO time of 100 ns ticks since year 1."""
    return (datetime(1, 1, 1, tzinfo=UTC) + timedelta(microseconds=ticks // 10)).isoformat() if ticks > 0 else None


def platform_of(name: str) -> str | None:
    """The platform that a file's name tells."""
    m = re.search(r"(?i)iphone|ios|android", name)
    return None if m is None else "Android" if m[0].lower() == "android" else "IPhonePlayer"


def info(data: bytes, path: str) -> dict:
    """The capture's metadata, from its header entries only."""
    c = S.Container(data)
    target = S.target_info(c)
    ticks = c.array("record_date", "<i8")
    page = c.array("page_size", "<u8") if c.version >= S.V_PAGES else []
    return {
        "snapshot_path": path, "exported_at_utc": datetime.now(UTC).isoformat(), "engine_version": target.get("engine_version"), "snap_format_version": c.version or None,
        "session_guid": target.get("session_guid") or None, "product_name": target.get("product_name"), "platform": target.get("platform") or (S.legacy_platform(c) or "").strip() or platform_of(path),
        "record_date_utc": utc_of(int(ticks[0])) if len(ticks) else None, "page_size": int(page[0]) or None if len(page) else None,
    }


def edges_of(c: S.Container, handles: int, instance: np.ndarray, handle_of: np.ndarray) -> list[tuple[int, int]]:
    """Unified index pairs: handles first, then native objects. Later formats name objects by instance id."""
    if not (c.has("edge_from") and c.has("edge_to")):
        return []
    if c.version < S.V_EDGES:
        return list(zip(c.array("edge_from", "<i4").tolist(), c.array("edge_to", "<i4").tolist(), strict=True))
    kind = "<u8" if c.version >= S.V_WIDE_IDS else "<u4"
    place = {int(x): handles + k for k, x in enumerate(instance)}
    pairs = zip(c.array("edge_from", kind).tolist(), c.array("edge_to", kind).tolist(), strict=True)
    out = [(place[a], place[b]) for a, b in pairs if a in place and b in place]
    last = {int(x): int(h) for x, h in zip(instance, handle_of, strict=True) if h >= 0}
    return out + [(place[x], h) for x, h in last.items()]


def tables_of(data: bytes, path: str) -> dict[str, list[dict]]:
    """The rows of each table, and of those of EXTRA."""
    c = S.Container(data)
    meta = info(data, path)
    out: dict[str, list[dict]] = {t: [] for t in (*EXTRACTED, *EXTRA)}
    out["schema_meta"].append({"schema_version_major": VERSION[0], "schema_version_minor": VERSION[1], "tool_version": None, "created_at_utc": meta["exported_at_utc"]})
    out["snapshot_info"].append(meta)
    stats = S.target_stats(c)
    if stats:
        out["target_stats"].append({k: _signed(v) for k, v in stats.items()})

    n = c.count("root_id")
    roots = c.array("root_id", "<i8", n, 0)
    area, owner, size = c.strings("root_area", n), c.strings("root_object", n), c.array("root_size", "<u8", n, 0)

    pages = None
    if c.version >= S.V_PAGES and c.has("page_state") and meta["page_size"]:
        bits = np.unpackbits(np.frombuffer(b"".join(c.raw("page_state")), np.uint8), bitorder="little").astype(bool)
        k = c.count("page_address")
        pages = bits, meta["page_size"], c.array("page_address", "<u8", k, 0), c.array("page_first", "<i4", k, 0), c.array("page_last", "<i4", k, 0)
        out["page_runs"] = page_runs(*pages)

    k = c.count("system_address") if c.version >= S.V_SYSTEM else 0
    starts = c.array("system_address", "<u8", k, 0) if k else np.zeros(0, "<u8")
    if k:
        sizes, resident, kinds, names = c.array("system_size", "<u8", k, 0), c.array("system_resident", "<u8", k, 0), c.array("system_type", "<i4", k, 0), c.strings("system_name", k)
        out["system_memory_regions"] = [{"region_index": i, "address": _signed(starts[i]), "size_bytes": _signed(sizes[i]), "resident_bytes": _signed(resident[i]), "type": int(kinds[i]), "name": names[i]} for i in range(k)]

    m = c.count("region_base")
    base, extent, names = c.array("region_base", "<u8", m, 0), c.array("region_size", "<u8", m, 0), c.strings("region_name", m)
    parent, first, count = c.array("region_parent", "<i4", m, -1), c.array("region_first", "<i4", m, -1), c.array("region_count", "<i4", m, 0)
    out["memory_regions"] = [
        {"region_index": i, "address_base": _signed(base[i]), "address_size": _signed(extent[i]), "name": names[i], "parent_region_index": int(parent[i]) if parent[i] >= 0 else None,
         "first_allocation_index": int(first[i]) if first[i] >= 0 else None, "num_allocations": int(count[i])} for i in range(m)
    ]

    a = c.count("alloc_address")
    where, bytes_, over, pad = (c.array(x, "<u8", a, 0) for x in ("alloc_address", "alloc_size", "alloc_overhead", "alloc_padding"))
    region, root = c.array("alloc_region", "<i4", a, -1), c.array("alloc_root", "<i8", a, -1)
    out["native_allocations"] = [
        {"allocation_index": i, "address": _signed(where[i]), "size_bytes": _signed(bytes_[i]), "overhead_size_bytes": _signed(over[i]), "padding_size_bytes": _signed(pad[i]),
         "memory_region_index": int(region[i]) if region[i] >= 0 else None, "root_reference_id": int(root[i]) if root[i] >= 0 else None} for i in range(a)
    ]

    o = c.count("object_size")
    address, room, flags = c.array("object_address", "<u8", o, 0), c.array("object_size", "<u8", o, 0), c.array("object_flags", "<i4", o, 0)
    kind, held, names, types = c.array("object_type", "<i4", o, -1), c.array("object_root", "<i8", o, -1), c.strings("object_name", o), c.strings("native_type_name")
    instance = c.array("instance_id", "<u8" if c.version >= S.V_WIDE_IDS else "<u4", o, 0)
    signed_ids = instance.astype("<i4") if c.version < S.V_WIDE_IDS else instance
    handle = np.full(o, -1)
    if c.version >= S.V_EDGES:
        entry = "object_handle" if c.has("object_handle") or c.version >= S.V_SCENES else "object_handle_old"
        given = c.array(entry, "<i4")[:o]
        handle[: len(given)] = given

    root_resident = _residents(pages, starts, where, bytes_, root, address, room, held)
    ids = set(roots.tolist())
    for i in range(o):
        # An object counts as resident what its root does; unknown roots and older formats leave it unknown.
        known = pages is not None and held[i] >= 1 and int(held[i]) in ids
        out["native_objects"].append({
            "native_object_index": i, "instance_id": str(signed_ids[i]), "name": names[i], "size_bytes": _signed(room[i]), "native_object_address": _signed(address[i]), "root_reference_id": int(held[i]),
            "type_index": int(kind[i]) if kind[i] >= 0 else None, "native_type_name": types[kind[i]] if 0 <= kind[i] < len(types) else "", "is_destroyed": bool(flags[i] & 8),
            "resident_size_bytes": root_resident.get(int(held[i]), 0) if known else None,
        })
    for i in range(n):
        out["native_roots"].append({"root_index": i, "root_id": int(roots[i]), "area_name": area[i], "object_name": owner[i], "accumulated_size_bytes": _signed(size[i]), "resident_size_bytes": int(root_resident.get(int(roots[i]), 0)) if pages is not None else None})

    handles = c.array("handle_target", "<u8").tolist()
    raw_starts = c.array("heap_start", "<u8")
    vm = (raw_starts & S.VM_BIT) != 0 if c.version >= S.V_HEAP_KIND else np.zeros(len(raw_starts), bool)
    heap_starts = raw_starts & ~S.VM_BIT if c.version >= S.V_HEAP_KIND else raw_starts
    out["heap_sections"] = [{"section_index": i, "address": _signed(s), "size_bytes": len(b), "is_vm": bool(v)} for i, (s, b, v) in enumerate(zip(heap_starts, c.raw("heap_bytes"), vm, strict=True))]
    links: dict[tuple, None] = {}
    managed_at: dict[int, int] = {}
    if c.has("vm") and c.has("type_name"):
        heap = Heap(c, heap_starts)
        found = heap.crawl(handles)
        managed_at = found.index
        native_at: dict[int, int] = {}
        taken: set[int] = set()
        for i, h in enumerate(handle.tolist()):
            if 0 <= h < len(handles) and h not in taken:  # the first object of a handle counts
                taken.add(h)
                native_at[handles[h]] = i
        for i, (at, z, t) in enumerate(found.objects):
            native = native_at.get(at)
            out["managed_objects"].append({"managed_object_index": i, "address": _signed(at), "size_bytes": z, "type_index": t, "managed_type_name": heap.names[t], "native_object_index": native})
    # A unified index below the number of handles is the managed object at the handle's address.
    end = lambda u: ("native_object", u - len(handles)) if u >= len(handles) else ("managed_object", managed_at.get(handles[u])) if u >= 0 else (None, None)
    for u, v in edges_of(c, len(handles), instance, handle):
        (fk, fi), (tk, ti) = end(u), end(v)
        if fi is not None and ti is not None:
            links[fk, fi, tk, ti, "native_connection"] = None
    if managed_at:
        for x, y in found.references:
            links["managed_object", x, "managed_object", y, "managed_reference"] = None
        for r in out["managed_objects"]:
            if r["native_object_index"] is not None:
                links["managed_object", r["managed_object_index"], "native_object", r["native_object_index"], "managed_native_bridge"] = None
                links["native_object", r["native_object_index"], "managed_object", r["managed_object_index"], "native_gc_handle_bridge"] = None
    out["connections"] = [dict(zip(("from_kind", "from_index", "to_kind", "to_index", "connection_type"), x, strict=True)) for x in links]
    out["row_counts"] = [{"table_name": t, "rows": len(out[t])} for t in EXTRACTED]
    return out


def page_runs(bits: np.ndarray, page: int, base: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[dict]:
    """Of each region the bounds of its pages and the runs of resident ones, by address; one of size 0 if there is none."""
    out = []
    for region, (at, lo, hi) in enumerate(zip(base.tolist(), first.tolist(), last.tolist(), strict=True)):
        low, pages = at // page * page, max(0, min(hi, len(bits) - 1) - lo + 1)
        mine = np.concatenate([[False], bits[lo : lo + pages], [False]]).astype(np.int8)
        turns = np.flatnonzero(np.diff(mine))
        for a, b in zip(turns[::2].tolist() or [0], turns[1::2].tolist() or [0], strict=True):
            out.append({"region": region, "low": _signed(low), "high": _signed(low + pages * page), "start": _signed(low + a * page), "size": (b - a) * page})
    return out


def _residents(pages, regions, where, sizes, roots, address, room, held) -> dict[int, int]:
    """Resident bytes of each root by the flat sweep."""
    by_root: dict[int, int] = {}
    if pages is None:
        return by_root
    bits, page, base, first, last = pages
    points = [(int(s), 1, "r", i) for i, s in enumerate(regions)]
    for tag, at, size in (("a", where, sizes), ("o", address, room)):
        for i in np.flatnonzero((at != 0) & (size != 0)).tolist():
            points += [(int(at[i]), 2 if tag == "a" else 3, tag, i), (int(at[i]) + int(size[i]), 0, tag, i)]
    points.sort(key=lambda p: p[:2])
    region = -1
    for (at, rank, tag, i), (nxt, *_) in zip(points, points[1:], strict=False):
        region = i if rank == 1 else region
        if rank < 2 or not 0 <= region < len(base) or nxt == at:
            continue
        got = int(resident_ranges(bits, page, int(first[region]), int(last[region]), int(base[region]), np.array([at]), np.array([nxt - at]))[0])
        root = int((roots if tag == "a" else held)[i])
        if root >= 1:
            by_root[root] = by_root.get(root, 0) + got
    return by_root


def _struct(table: str):
    return schema(table) if table in TABLES else EXTRA[table]


def header_of(path: str) -> dict | None:
    """info() of a capture file, of which only the parts that it needs are read; None if there is none.

    Local files are mapped into memory; other file systems read the file.
    """
    import mmap
    import os

    local = path.removeprefix("file://")
    if "://" not in local:
        if not os.path.exists(local):
            return None
        with open(local, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            return info(memoryview(data), path)
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return None
    with system.open_input_file(at) as f:
        return info(f.read(), path)


def capture_names(spark: SparkSession, folder: str, name_filter: str = "") -> list[str]:
    """Names of the captures directly in a folder that hold the filter in any case of letters, without reading them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [x.getPath().getName() for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if x.isFile()]
    return sorted(n.removesuffix(".snap") for n in found if n.endswith(".snap") and name_filter.lower() in n.lower())


def extract(spark: SparkSession, folder: str, out: str, name_filter: str = "", names: list[str] | None = None) -> list[str]:
    """Write the tables of captures directly in a folder to out/<table>, with their snapshot_id; the ids.

    names: only these captures; by default all that the filter leaves.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.snap").option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where(F.contains(F.lower(name), F.lit(name_filter.lower())))
    if names is not None:
        files = files.where(name.isin(*[f"{n}.snap" for n in names]))
    tables = (*EXTRACTED, *EXTRA)
    empty = {t: spark.createDataFrame([], _struct(t)).schema for t in tables}
    arrow = pa.schema([("snapshot_id", pa.string()), ("table", pa.string()), *((t, to_arrow_type(s)) for t, s in empty.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name = path.rsplit("/", 1)[-1].removesuffix(".snap")
                for t, rows in tables_of(data.as_py(), path).items():
                    for k in range(0, len(rows), 65_536):
                        part = pa.array(rows[k : k + 65_536], arrow.field(t).type)
                        n = len(part)
                        # One column is full, the others cost nothing but their null bits.
                        yield pa.RecordBatch.from_arrays([pa.repeat(name, n), pa.repeat(t, n), *(part if c == t else pa.nulls(n, arrow.field(c).type) for c in tables)], schema=arrow)

    ddl = "snapshot_id string, `table` string, " + ", ".join(f"{t} {s.simpleString()}" for t, s in empty.items())
    # A file is decoded by one task; all its rows are written once and read back by table.
    files.select("path", "content").repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(run, ddl).write.partitionBy("table").mode("overwrite").parquet(out)
    return [r.snapshot_id for r in spark.read.schema(ddl).parquet(out).where("`table` = 'snapshot_info'").select("snapshot_id").distinct().orderBy("snapshot_id").collect()]


def load(spark: SparkSession, store: str, snapshot_id: str | None = None) -> Snapshot:
    """The tables of one stored snapshot, or of all with their snapshot_id."""
    df = spark.read.parquet(store)
    df = df.where(F.col("snapshot_id") == snapshot_id) if snapshot_id is not None else df
    keep = [] if snapshot_id is not None else ["snapshot_id"]
    part = lambda t: df.where(F.col("table") == t).select(*keep, f"{t}.*")
    return Snapshot(spark, {t: part(t) for t in (*EXTRACTED, *EXTRA)})

