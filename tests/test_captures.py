import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heaplens import cli
from heaplens.operators import sweep
from heaplens.operators.residency import resident_ranges, resident_spans
from heaplens.plans import quality, summary
from heaplens.sources import snap as S
from heaplens.sources import store
from heaplens.sources.captures import extract, header_of, load, page_runs, platform_of, tables_of, utc_of


def version(v):
    return {"version": ("single", struct.pack("<I", v))}


@given(st.lists(st.text(max_size=9), max_size=9), st.lists(st.integers(0, 2**64 - 1), max_size=30), st.integers(1, 100))
@settings(max_examples=60, deadline=None)
def test_container_round_trip(names, numbers, chunk):
    names = [n for n in names if "\ud800" not in n]
    c = S.Container(S.write({"root_object": ("strings", names), "root_size": ("<u8", numbers), **version(9)}, chunk))
    assert c.strings("root_object") == names and c.array("root_size", "<u8").tolist() == numbers and c.version == 9
    assert c.count("root_size") == len(numbers) and not c.has("root_id")


def test_damaged_files_are_refused():
    data = S.write(version(9))
    for bad in (b"", data[:20], b"\0" + data[1:], data[:-1] + b"\0"):
        with pytest.raises(S.CaptureError):
            S.Container(bad)
    with pytest.raises(S.CaptureError):
        S.Container(S.write({"root_id": ("<i8", [1]), "root_size": ("<u8", [1, 2])})).array("root_size", "<u8", 1)


def test_minimal_roots():
    rows = tables_of(S.write({**version(1), "root_id": ("<i8", [123]), "root_area": ("strings", ["Scene"]), "root_object": ("strings", ["Root"]), "root_size": ("<u8", [1000])}), "x.snap")
    assert rows["native_roots"] == [{"root_index": 0, "root_id": 123, "area_name": "Scene", "object_name": "Root", "accumulated_size_bytes": 1000, "resident_size_bytes": None}]


def one_object(**more):
    return {"native_type_name": ("strings", ["GameObject"]), "object_type": ("<i4", [0]), "instance_id": ("<i4", [42]), "object_name": ("strings", ["MyGo"]), "object_size": ("<u8", [64]), "object_flags": ("<i4", [0]), "object_address": ("<u8", [0]), "object_root": ("<i8", [-1]), **more}


def test_minimal_object():
    (r,) = tables_of(S.write({**version(1), **one_object()}), "x.snap")["native_objects"]
    assert (r["native_object_index"], r["instance_id"], r["name"], r["size_bytes"], r["native_object_address"]) == (0, "42", "MyGo", 64, 0)
    assert (r["resident_size_bytes"], r["native_type_name"], r["is_destroyed"], r["root_reference_id"]) == (None, "GameObject", False, -1)


def paged(v):
    obj = one_object(object_size=("<u8", [4096]), object_address=("<u8", [0x1000]), object_root=("<i8", [1]))
    more = {"root_id": ("<i8", [1]), "root_size": ("<u8", [4096]), "system_address": ("<u8", [0x1000]), "system_size": ("<u8", [8192]), "system_resident": ("<u8", [4096])}
    pages = {"page_address": ("<u8", [0x1000]), "page_first": ("<i4", [0]), "page_last": ("<i4", [0]), "page_state": ("u1", [1]), "page_size": ("<u8", [4096])}
    return tables_of(S.write({**version(v), **obj, **more, **(pages if v >= 17 else {})}), "x.snap")


def test_resident_by_format():
    new, old = paged(17), paged(16)
    assert new["native_objects"][0]["resident_size_bytes"] == 4096 and new["snapshot_info"][0]["page_size"] == 4096
    assert old["native_objects"][0]["resident_size_bytes"] is None and len(old["system_memory_regions"]) == 1 and old["snapshot_info"][0]["page_size"] is None


def heap_file():
    """A list of two objects, one of which holds a string and its list; type 0 object, 1 node, 2 node[], 3 string."""
    base, heap = 0x10000, bytearray(0x200)
    info = [0x9000, 0x9100, 0x9200, 0x9300]

    def put(at, *values):
        struct.pack_into(f"<{len(values)}Q", heap, at, *values)

    put(0x00, info[2], 0, 0)  # array: type, monitor, bounds
    struct.pack_into("<i", heap, 0x18, 2)
    put(0x20, base + 0x40, base + 0x80)
    put(0x40, info[1], 0, base + 0xC0, base + 0x00)  # node: string, array
    put(0x80, base + 0x180, 0, 0, 0)  # node whose header points to its type by one step
    put(0x180, info[1])
    put(0xC0, info[3], 0)
    struct.pack_into("<i", heap, 0xD0, 3)
    types = {
        "type_name": ("strings", ["System.Object", "Node", "Node[]", "System.String"]), "type_flags": ("<i4", [0, 0, 2 | 1 << 16, 0]), "type_base": ("<i4", [-1, 0, 1, 0]),
        "type_size": ("<i4", [16, 32, 0, 20]), "type_info": ("<u8", info), "type_fields": ("bytes", [b"", struct.pack("<2i", 0, 1), b"", b""]),
        "type_statics": ("bytes", [b"", b"", b"", b""]), "field_offset": ("<i4", [16, 24]), "field_type": ("<i4", [3, 2]), "field_name": ("strings", ["s", "all"]), "field_static": ("u1", [0, 0]),
    }
    return S.write({
        **version(12), **types, "vm": ("<u4", [8, 16, 32, 16, 24, 8]), "heap_start": ("<u8", [base | 1 << 63]), "heap_bytes": ("bytes", [bytes(heap)]), "handle_target": ("<u8", [0, base]),
        **one_object(), "object_handle": ("<i4", [1]), "edge_from": ("<u4", [42, 7]), "edge_to": ("<u4", [42, 42]),
    })


def test_crawl_finds_objects_sizes_and_references():
    rows = tables_of(heap_file(), "x.snap")
    by = {r["managed_object_index"]: r for r in rows["managed_objects"]}
    found = {r["address"] - 0x10000: (r["managed_type_name"], r["size_bytes"], r["native_object_index"]) for r in by.values()}
    assert found == {0: ("Node[]", 48, 0), 0x40: ("Node", 32, None), 0x80: ("Node", 32, None), 0xC0: ("System.String", 28, None)}
    at = lambda i: by[i]["address"] - 0x10000
    kinds = {}
    for r in rows["connections"]:
        kinds.setdefault(r["connection_type"], set()).add((r["from_kind"][0], r["from_index"], r["to_kind"][0], r["to_index"]))
    assert {(at(a), at(b)) for _, a, _, b in kinds["managed_reference"]} == {(0, 0x40), (0, 0x80), (0x40, 0xC0), (0x40, 0)}
    assert kinds["managed_native_bridge"] == {("m", 0, "n", 0)} and kinds["native_gc_handle_bridge"] == {("n", 0, "m", 0)}
    assert kinds["native_connection"] == {("n", 0, "n", 0), ("n", 0, "m", 0)}
    assert rows["heap_sections"] == [{"section_index": 0, "address": 0x10000, "size_bytes": 512, "is_vm": True}]


def test_target_info_and_names():
    blob = bytearray(512)
    struct.pack_into("<Ii", blob, 0, 77, 8)
    struct.pack_into("<I", blob, 48, 8)
    blob[52:60] = b"2022.3.1"
    struct.pack_into("<I", blob, 68, 4)
    blob[72:76] = b"Game"
    (r,) = tables_of(S.write({**version(11), "target_info": ("single", bytes(blob)), "record_date": ("single", struct.pack("<q", 638_000_000_000_000_000))}), "x.snap")["snapshot_info"]
    assert (r["session_guid"], r["platform"], r["engine_version"], r["product_name"]) == (77, "IPhonePlayer", "2022.3.1", "Game")
    assert r["record_date_utc"] == utc_of(638_000_000_000_000_000) == "2022-09-28T22:13:20+00:00"
    assert platform_of("a_IOS_b") == "IPhonePlayer" and platform_of("x_android") == "Android" and platform_of("pc") is None


def test_folder_to_tables(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / "MyGame_menu.snap").write_bytes(heap_file())
    (folder / "mygame_b.snap").write_bytes(S.write({**version(1), "root_id": ("<i8", [5]), "root_area": ("strings", ["é"]), "root_object": ("strings", ["o"]), "root_size": ("<u8", [2**63])}))
    (folder / "Other.snap").write_bytes(S.write(version(1)))
    (folder / "readme.txt").write_text("no")
    assert extract(spark, str(folder), store, "mygame") == ["MyGame_menu", "mygame_b"]
    t = load(spark, store, "MyGame_menu")
    assert t.managed_objects.count() == 4 and t.native_roots.count() == 0
    assert quality.validate(t).collect() == []
    assert load(spark, store).native_roots.first().accumulated_size_bytes == -(2**63)
    spans = summary.classified(t, sweep.nested_spans(summary.intervals(t, t.heap_sections)), t.heap_sections)
    got = {(r.metric_group, r.category): r.committed_bytes for r in summary.summary_metrics(spans, False).collect()}
    assert got["AllocatedMemoryDistribution", "Managed"] == 512 and got["ManagedHeapUtilization", "Objects"] == 48 + 32 + 32 + 28
    assert np.isclose(got["ManagedHeapUtilization", "Virtual Machine"], 512 - 140)


def pages_file(v=17, **more):
    """Two system regions of four and two pages, of which 1, 3 and 4 are resident; a root, an allocation, an object."""
    return S.write({
        **version(v), "root_id": ("<i8", [1, 2]), "root_area": ("strings", ["a", "b"]), "root_object": ("strings", ["x", "IL2CPP VM"]), "root_size": ("<u8", [0, 0]),
        "system_address": ("<u8", [0x1000, 0x9000]), "system_size": ("<u8", [0x4000, 0x2000]), "system_resident": ("<u8", [0, 0]), "system_type": ("<i4", [0, 3]), "system_name": ("strings", ["[anon:dalvik-x]", "/dev/kgsl"]),
        "page_address": ("<u8", [0x1000, 0x9000]), "page_first": ("<i4", [0, 4]), "page_last": ("<i4", [3, 5]), "page_state": ("u1", [0b011010]), "page_size": ("<u8", [0x1000]),
        "alloc_address": ("<u8", [0x1800, 0x3000]), "alloc_size": ("<u8", [0x1000, 0x800]), "alloc_region": ("<i4", [-1, -1]), "alloc_root": ("<i8", [1, 2]), "alloc_overhead": ("<u8", [0, 0]), "alloc_padding": ("<u8", [0, 0]), **more,
    })


def metrics_of(spark, tmp_path, data, name="one"):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f"{name}.snap").write_bytes(data)
    assert cli.export(spark, str(tmp_path / "in"), str(tmp_path / "out"), name, "full") == 0
    return {(r.metric_group, r.category): (r.committed_bytes, r.resident_bytes, r.resident_available) for r in store.read(spark, str(tmp_path / "out" / name)).summary_metrics.collect()}


def test_exported_metrics_have_resident_bytes(spark, tmp_path):
    got = metrics_of(spark, tmp_path, pages_file())
    # Pages 0x2000, 0x4000 and 0x9000 are resident; the allocations hold 0x1800-0x2800 and 0x3000-0x3800.
    assert got["Totals", "Total"] == (0x6000, 0x3000, 1)
    d = "AllocatedMemoryDistribution"
    assert got[d, "Native"] == (0x1000, 0x800, 1) and got[d, "Managed"] == (0x800, 0, 1)
    assert got[d, "Graphics (Estimated)"] == (0x2000, 0, 0) and got[d, "Untracked"] == (0x2800, 0, 0)
    old = metrics_of(spark, tmp_path, pages_file(16), "old")
    assert old["Totals", "Total"] == (0x6000, 0, 1)


def test_exported_metrics_know_platform_and_device(spark, tmp_path):
    d = "AllocatedMemoryDistribution"
    droid = metrics_of(spark, tmp_path, pages_file(), "game_android")
    assert droid[d, "Android Runtime"] == (0x2800, 0x1800, 1) and droid[d, "Graphics (Estimated)"] == (0x2000, 0, 0)
    stats = struct.pack("<5Q", 0x100000, 0, 0, 0, 0x2800)
    more = metrics_of(spark, tmp_path, pages_file(target_stats=("single", stats)), "stats")
    assert more[d, "Graphics (Estimated)"] == (0x2800, 0, 0) and more[d, "Untracked"] == (0x2000, 0, 0) and more["Totals", "Total"] == (0x6000, 0x3000, 1)


def test_runs_of_pages():
    rows = page_runs(np.array([0, 1, 1, 0, 1, 0], bool), 4096, np.array([0x1234, 0x9000, 0x20000]), np.array([0, 4, 5]), np.array([3, 4, 9]))
    assert [(r["region"], r["low"], r["high"], r["start"], r["size"]) for r in rows] == [(0, 0x1000, 0x5000, 0x2000, 0x2000), (1, 0x9000, 0xA000, 0x9000, 0x1000), (2, 0x20000, 0x21000, 0x20000, 0)]


def test_residents_of_spans_are_those_of_the_ranges(spark):
    rng = np.random.default_rng(4)
    bits, base, first, last = rng.random(60) < 0.5, np.array([0x10000, 0x80000]), np.array([0, 40]), np.array([39, 59])
    runs = spark.createDataFrame([{"snapshot_id": s, **r} for s in "ab" for r in page_runs(bits, 4096, base, first, last)])
    rows = []
    for region in (0, 1):
        at = int(base[region]) - 4096
        while at < int(base[region]) + 42 * 4096:
            size = int(rng.integers(1, 30_000))
            rows.append(("a", region, at, size))
            at += size
    spans = spark.createDataFrame(rows + [("b", *r[1:]) for r in rows[:5]], "snapshot_id string, region long, address long, size long")
    for r in resident_spans(spans, runs).collect():
        i = r.region
        assert r.resident == resident_ranges(bits, 4096, int(first[i]), int(last[i]), int(base[i]), np.array([r.address]), np.array([r.size]))[0]


def test_headers_are_read_alone(tmp_path):
    path = tmp_path / "x_ios.snap"
    path.write_bytes(pages_file())
    got = header_of(str(path))
    assert got["platform"] == "IPhonePlayer" and got["page_size"] == 0x1000 and got["snap_format_version"] == 17 and header_of(str(tmp_path / "no.snap")) is None


def test_platforms_of_older_formats():
    def blob(text, platform):
        return struct.pack("<i", len(text)) + text.encode("utf-16-le") + struct.pack("<i", len(platform)) + platform.encode("utf-16-le")

    def platform(data, path="x.snap"):
        return tables_of(S.write({**version(8), "user_metadata": ("single", data)}), path)["snapshot_info"][0]["platform"]

    assert platform(blob("a note é", "Android")) == "Android" and platform(blob("", "PS4")) == "PS4"
    assert platform(blob("x", "") + b"....") == "Unknown Platform" and platform(b"123", "a_ios.snap") == "IPhonePlayer"
    assert platform(struct.pack("<i", 99) + b"1234") is None
