import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heaplens.catalog import Snapshot
from heaplens.functions.numeric import human, rounded
from heaplens.operators import intervals, sweep
from heaplens.operators.graph import exclusive, reachable
from heaplens.operators.intervals import asof_contained, contained
from heaplens.operators.residency import resident_of, resident_ranges
from heaplens.plans import summary, views
from heaplens.plans.views import v_allocation_enriched
from heaplens.schema import changes_since, evaluate, schema


def test_overlapping_regions_tell_the_modes_apart(spark):
    regions = spark.createDataFrame([(0, 100, 1000, "big"), (1, 200, 50, "inner")], "r int, s long, z long, name string")
    at = spark.createDataFrame(list(enumerate([150, 220, 260, 50, 5000])), "k int, a long")
    got = lambda mode: [r.name for r in asof_contained(at, "k", "a", regions, "s", "z", "r", mode).orderBy("k").collect()]
    assert got("nearest_start") == ["big", "inner", None, None, None]
    assert got("nearest_covering") == ["big", "inner", "big", None, None]


def test_contained_against_brute_force(spark):
    rng = random.Random(4)
    regions = [(i, rng.randint(-5000, 5000), rng.choice([0, 1, 7, 64, 65, 4000, 1 << 20, 1 << 40])) for i in range(60)]
    points = [(k, rng.randint(-6000, 20000)) for k in range(300)]
    got = contained(spark.createDataFrame(points, "k int, a long"), "a", spark.createDataFrame(regions, "r int, s long, z long"), "s", "z").select("k", "r").collect()
    assert sorted(map(tuple, got)) == sorted((k, r) for k, a in points for r, s, z in regions if s <= a < s + z)
    left = contained(spark.createDataFrame(points, "k int, a long"), "a", spark.createDataFrame([], "r int, s long, z long"), "s", "z", "left")
    assert left.count() == 300 and left.where("r is not null").count() == 0


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_points_stay_where_they_are_if_intervals_are_few(spark, monkeypatch, most):
    monkeypatch.setattr(intervals, "BROADCAST", most)
    rng = random.Random(6)
    regions = [(i, s, rng.choice([0, 1, 50, 70, 5000, 1 << 20]), rng.choice("ab")) for i, s in enumerate(rng.sample(range(-5000, 5000), 80))]
    points = [(k, rng.randint(-6000, 20000)) for k in range(300)]
    want = []
    for k, a in points:
        last = max((r for r in regions if r[1] <= a), key=lambda r: r[1], default=None)
        want.append((k, a, last[0], last[3]) if last and a < last[1] + last[2] else (k, a, None, None))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        args = spark.createDataFrame(points, "k int, a long"), "k", "a", spark.createDataFrame(regions, "r int, s long, z long, name string"), "s", "z", "r"
        every, some = asof_contained(*args), asof_contained(*args, only=F.col("name") == "a")
        assert sorted(map(tuple, every.select("k", "a", "r", "name").collect())) == sorted(want)
        assert sorted(map(tuple, some.select("k", "a", "r", "name").collect())) == sorted(w for w in want if w[3] == "a")
        for df in (every, some):
            moved = "hashpartitioning(k#" in df._jdf.queryExecution().executedPlan().toString()
            assert moved == (most == 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_enriched_allocations_are_shuffled_by_root_only(spark):
    from heaplens.catalog import from_star

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = v_allocation_enriched(from_star(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(allocation_index#" not in plan and "hashpartitioning(root_reference_id#" in plan


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_allocations_find_the_objects_of_their_root_where_they_are(spark, monkeypatch, most):
    monkeypatch.setattr(views, "BROADCAST", most)
    roots, kinds = [1, 2, 2, 3, 5], [(10, 1, "a"), (11, 1, None), (12, 2, "b"), (13, 4, "c"), (14, 9, "d"), (15, 4, "c")]
    owned = [(0, 1, 7), (1, 2, None), (2, 3, 8), (3, 4, 7), (4, 6, 7), (5, None, 8), (6, 1, 7)]
    rows = {
        "native_allocations": [{"allocation_index": i, "address": i * 10 + 1, "size_bytes": 4, "root_reference_id": r, "memory_region_index": m} for i, r, m in owned],
        "native_roots": [{"root_index": i, "root_id": r, "area_name": f"area{i}"} for i, r in enumerate(roots)],
        "native_objects": [{"native_object_index": i, "root_reference_id": r, "native_type_name": k, "name": f"o{i}"} for i, r, k in kinds],
        "memory_regions": [{"region_index": 7, "name": "seven"}],
    }
    want = []
    for i, r, m in owned:
        for area in [f"area{j}" for j, x in enumerate(roots) if x == r] or [None]:
            want += [(i, "seven" if m == 7 else None, r, area, *o) for o in [(j, k, f"o{j}") for j, x, k in kinds if x == r] or [(None,) * 3]]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = v_allocation_enriched(Snapshot(spark, {n: table(spark, n, x) for n, x in rows.items()}))
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = df.select("allocation_index", "unity_region_name", "root_reference_id", "area_name", "native_object_index", "native_type_name", "object_name").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert ("SortMergeJoin" in plan) == (most == 0)


def test_equal_starts_take_the_largest(spark):
    regions = spark.createDataFrame([(5, 10, 4), (2, 10, 9), (1, 10, 9)], "r int, s long, z long")
    at = spark.createDataFrame([(0, 17)], "k int, a long")
    assert asof_contained(at, "k", "a", regions, "s", "z", "r").first().r == 1


def test_exclusive_set(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (9, 1), (0, 3), (3, 0)], "src long, dst long")
    reach = reachable(edges, spark.createDataFrame([(0,), (7,)], "root long"))
    assert sorted(map(tuple, reach.select("root", "node").collect())) == [(0, 0), (0, 1), (0, 2), (0, 3)]
    assert sorted(r.node for r in exclusive(edges, reach).collect()) == [0, 2, 3]


def spans_of(spark, rows):
    df = spark.createDataFrame([("s", k, i, a, z) for k, i, a, z in rows], "snapshot_id string, kind int, idx long, address long, size long")
    return df, sorted((r.kind, r.idx, r.address, r.size) for r in sweep.nested_spans(df).collect())


def test_nested_object_against_the_flat_sweep(spark):
    _, spans = spans_of(spark, [(sweep.SYSTEM, 0, 0, 1000), (sweep.ALLOCATION, 0, 100, 400), (sweep.OBJECT, 0, 200, 100)])
    size = lambda kind: sum(z for k, _, _, z in spans if k == kind)
    assert (size(sweep.ALLOCATION), size(sweep.OBJECT), size(sweep.SYSTEM)) == (300, 100, 600)
    regions = spark.createDataFrame([("s", 0, 0)], "snapshot_id string, idx long, address long")
    owned = spark.createDataFrame([("s", "allocation", 0, 100, 400), ("s", "object", 0, 200, 100)], "snapshot_id string, source string, idx long, address long, size long")
    assert sorted((r.source, r.size) for r in sweep.flat_spans(regions, owned).collect()) == [("allocation", 100), ("object", 100)]


@given(st.lists(st.tuples(st.integers(1, 6), st.integers(0, 40), st.integers(1, 20)), min_size=1, max_size=12))
@settings(max_examples=15, deadline=None)
def test_islands_change_nothing(spark, rows):
    """The sweep in islands gives the spans of one serial sweep over all points."""
    rows = [(k, i, a * 3, z) for i, (k, a, z) in enumerate(rows)]
    pts = sorted(((at, end, k, i) for k, i, a, z in rows for at, end in ((a, False), (a + z, True))), key=lambda p: (p[0], not p[1], -p[2] if p[1] else p[2], -p[3] if p[1] else p[3]))
    own = sweep.owners([(at, k, i, end) for at, end, k, i in pts])
    want = sorted((k, i, p[0], q[0] - p[0]) for (k, i), p, q in zip(own, pts, pts[1:], strict=False) if k != sweep.FREE and q[0] > p[0])
    assert spans_of(spark, rows)[1] == want


def test_an_island_is_streamed_in_batches(tmp_path, monkeypatch):
    """One island over several files: no step holds more than a batch of it, and the spans are those of a serial sweep."""
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(sweep, "BATCH", 7)
    rnd = random.Random(1)
    rows = [(1, 0, 0, 500)] + [(rnd.randint(2, 6), i, rnd.randint(0, 900), rnd.randint(1, 90)) for i in range(1, 300)]
    pts = sorted(p for k, i, a, z in rows for key in [(k << sweep.KIND) + i + sweep.HALF] for p in ((a, key), (a + z, -key)))
    cuts, files, opened = [0, 100, 101, 350, len(pts)], [], []
    for low, high in zip(cuts, cuts[1:], strict=False):
        files.append(f"file://{tmp_path}/{low}.parquet")
        opened.append(sum(1 if key > 0 else -1 for _, key in pts[:low]))
        pq.write_table(pa.table({"snapshot_id": ["s"] * (high - low), "at": [a for a, _ in pts[low:high]], "key": [k for _, k in pts[low:high]]}), tmp_path / f"{low}.parquet")
    taken, after = [], sweep.Owners.after
    own = sweep.Owners().after([k for _, k in pts])
    monkeypatch.setattr(sweep.Owners, "after", lambda self, keys: taken.append(len(keys)) or after(self, keys))
    got = [(r["kind"], r["idx"], r["address"], r["size"]) for n in range(len(files)) for b in sweep._swept(files, opened, n) for r in b.to_pylist()]
    want = [(k >> sweep.KIND, (k & ((1 << sweep.KIND) - 1)) - sweep.HALF, p[0], q[0] - p[0]) for k, p, q in zip(own, pts, pts[1:], strict=False) if k and q[0] > p[0]]
    assert got == want and max(taken) <= 7 and sum(taken) >= len(pts)


def table(spark, name, rows):
    fields = schema(name).fieldNames()
    full = [tuple(r.get(f) for f in fields) for r in rows]
    loose = schema(name)
    for f in loose.fields:
        f.nullable = True
    return spark.createDataFrame(full, loose)


def region(i, a, z, kind=0, name=""):
    return {"region_index": i, "address": a, "size_bytes": z, "resident_bytes": 0, "type": kind, "name": name}


def metrics(spark, t, heap=None, **more):
    spans = summary.classified(t, sweep.nested_spans(summary.intervals(t, heap)), heap, **more)
    return {(r.metric_group, r.category): r.committed_bytes for r in summary.summary_metrics(spans).collect()}


def test_summary_of_a_known_layout(spark):
    t = Snapshot(spark, {
        "system_memory_regions": table(spark, "system_memory_regions", [region(0, 0x1000, 0x2000)]),
        "native_allocations": table(spark, "native_allocations", [{"allocation_index": 0, "address": 0x1400, "size_bytes": 0x400}]),
    })
    heap = spark.createDataFrame([(0, 0x2000, 0x400, True)], "section_index int, address long, size_bytes long, is_vm boolean")
    got = metrics(spark, t, heap)
    assert got["Totals", "Total"] == 8192
    assert [got["AllocatedMemoryDistribution", c] for c in ("Native", "Managed", "Executables & Mapped", "Graphics (Estimated)", "Untracked")] == [1024, 1024, 0, 0, 6144]
    assert [got["ManagedHeapUtilization", c] for c in ("Virtual Machine", "Objects", "Empty Heap Space")] == [1024, 0, 0]


def test_runtime_root_moves_to_managed(spark):
    t = Snapshot(spark, {
        "system_memory_regions": table(spark, "system_memory_regions", [region(0, 0x1000, 0x2000)]),
        "native_allocations": table(spark, "native_allocations", [{"allocation_index": i, "address": a, "size_bytes": 0x400, "root_reference_id": r} for i, a, r in ((0, 0x1000, 1), (1, 0x1800, 5))]),
        "native_roots": table(spark, "native_roots", [{"root_index": 0, "root_id": 1, "object_name": "Mono VM", "accumulated_size_bytes": 9999}]),
    })
    got = metrics(spark, t)
    assert [got["AllocatedMemoryDistribution", c] for c in ("Native", "Managed")] == [1024, 1024]
    assert got["ManagedHeapUtilization", "Virtual Machine"] == 1024


def test_region_types_and_names(spark):
    rows = [region(i, i * 100 + 100, 10, kind, name) for i, (kind, name) in enumerate([(0, "a"), (1, "b"), (2, "c"), (3, "d"), (0, "[anon:dalvik-x"), (0, "/dev/kgsl")])]
    t = Snapshot(spark, {"system_memory_regions": table(spark, "system_memory_regions", rows)})
    got = metrics(spark, t, android=True)
    assert [got["AllocatedMemoryDistribution", c] for c in ("Executables & Mapped", "Graphics (Estimated)", "Untracked", "Android Runtime")] == [10, 20, 20, 10]
    plain = metrics(spark, t)
    assert ("AllocatedMemoryDistribution", "Android Runtime") not in plain and plain["AllocatedMemoryDistribution", "Untracked"] == 40


def test_target_statistics(spark):
    t = Snapshot(spark, {"system_memory_regions": table(spark, "system_memory_regions", [region(0, 100, 50), region(1, 200, 30, 3)])})
    spans = summary.classified(t, sweep.nested_spans(summary.intervals(t)))
    for used, want in ((40, (40, 40)), (10, (10, 70)), (500, (80, 0))):
        got = {r.category: r.committed_bytes for r in summary.summary_metrics(spans, True, summary.TargetStats(used)).collect()}
        assert (got["Graphics (Estimated)"], got["Untracked"]) == want


def test_resident_pages(spark):
    bits = np.array([1, 0, 1, 1], bool)
    got = resident_ranges(bits, 4096, 0, 3, 0, np.array([0, 100, 4000, 8192, 12288, 0]), np.array([4096, 100, 5000, 8192, 8192, 0]))
    assert got.tolist() == [4096, 100, 96 + 808, 8192, 0, 0]
    ranges = spark.createDataFrame([(0, 0, 4096), (1, 100, 100), (2, 4000, 5000), (3, 8192, 8192)], "k int, address long, size long")
    pages = spark.createDataFrame([(i, bool(b)) for i, b in enumerate(bits)], "page long, resident boolean")
    assert [r.resident_bytes for r in resident_of(ranges, "k", pages, 4096).orderBy("k").collect()] == got[:4].tolist()


def test_rounding_and_units(spark):
    r = spark.sql("select 1.005D x, 1536L b")
    assert r.select(rounded(r.x, 2).alias("x")).first().x == 1.0
    assert r.select(human(r.b).alias("b")).first().b == "1.50 KB"


@pytest.mark.parametrize(("version", "want"), [((1, 3), "none"), ((1, 2), "upgrade_in_place"), ((0, 99), "re_export"), ((0, 0), "re_export"), ((2, 0), "tool_outdated"), ((1, 4), "tool_outdated")])
def test_versions(version, want):
    assert evaluate(*version) == want


def test_changes():
    assert changes_since(1, 3) == [] and [v for v, _ in changes_since(1, 2)] == [(1, 3)]


def test_enriched_view_keeps_every_allocation(spark):
    t = Snapshot(spark, {"native_allocations": table(spark, "native_allocations", [{"allocation_index": i, "address": i * 10 + 1, "size_bytes": 4} for i in range(5)])})
    assert v_allocation_enriched(t).count() == 5
