import json

import pytest

from heaplens import cli
from heaplens.catalog import Snapshot, from_star
from heaplens.plans import golden, multi, quality, render, reports, views
from heaplens.sources import store
from heaplens.streaming import follow, type_sizes
from tests.test_captures import heap_file
from tests.test_operators import table

SUMMARY = [
    ("Totals", "Total", 10_000_000, 4_000_000, 1), ("AllocatedMemoryDistribution", "Native", 5_000_000, 3_000_000, 1), ("AllocatedMemoryDistribution", "Managed", 2_000_000, 1_000_000, 1),
    ("AllocatedMemoryDistribution", "Executables & Mapped", 1_000_000, 0, 1), ("AllocatedMemoryDistribution", "Graphics (Estimated)", 1_000_000, 0, 0), ("AllocatedMemoryDistribution", "Untracked", 1_000_000, 0, 0),
    ("ManagedHeapUtilization", "Virtual Machine", 1_500_000, 800_000, 1), ("ManagedHeapUtilization", "Objects", 400_000, 200_000, 1), ("ManagedHeapUtilization", "Empty Heap Space", 100_000, 0, 1),
]


def snapshot(spark, extra_root=False, native=5_000_000):
    keys = ("metric_group", "category", "committed_bytes", "resident_bytes", "resident_available")
    roots = [(1, 2, "AssetBundle", "bundle", 100, 50), (0, 1, "SerializedFile", "file-a", 200, 80), (2, 3, "PersistentManager.Remapper", "Remapper", 300, 300)] + [(3, 4, "SerializedFile", "file-b", 0, 0)] * extra_root
    rows = [dict(zip(keys, r, strict=True)) for r in SUMMARY]
    rows[1]["committed_bytes"] = native
    return Snapshot(spark, {
        "native_objects": table(spark, "native_objects", [{"native_object_index": 0, "instance_id": "1", "name": "ab", "size_bytes": 100, "root_reference_id": 2, "native_type_name": "AssetBundle", "is_destroyed": False, "resident_size_bytes": 50}]),
        "native_roots": table(spark, "native_roots", [dict(zip(("root_index", "root_id", "area_name", "object_name", "accumulated_size_bytes", "resident_size_bytes"), r, strict=True)) for r in roots]),
        "summary_metrics": table(spark, "summary_metrics", rows),
    })


GOLDEN = {
    "NativeTypeMetrics": [{"NativeTypeName": "AssetBundle", "Count": 1, "AllocatedBytes": 100, "ResidentBytes": 50}, {"NativeTypeName": "SerializedFile", "Count": 1, "AllocatedBytes": 200, "ResidentBytes": 80}],
    "NativeRootMetrics": [{"AreaName": "PersistentManager.Remapper", "ObjectName": "Remapper", "AllocatedBytes": 300, "ResidentBytes": 300}],
    "TotalAllocatedBytes": 10_000_000, "TotalResidentBytes": 4_000_000,
    **{g: [{"Name": c + "*" * (c == "Untracked"), "CommittedBytes": n, "ResidentBytes": r, "ResidentAvailable": bool(a)} for x, c, n, r, a in SUMMARY if x == g] for g in ("AllocatedMemoryDistribution", "ManagedHeapUtilization")},
}


def test_golden_values(spark):
    assert golden.compare(snapshot(spark), GOLDEN) == []
    assert golden.compare(snapshot(spark, extra_root=True), GOLDEN)[0].startswith("SerializedFile.Count:")
    assert golden.compare(snapshot(spark, native=9000), GOLDEN)[0].startswith("Summary[AllocatedMemoryDistribution].Native.Committed:")
    assert golden.within(100_000_000, 101_000_000, golden.EXACT_COMMITTED) and not golden.within(100_000_000, 101_100_000, golden.EXACT_COMMITTED)


def test_quality_checks_find_what_is_planted(spark):
    t = Snapshot(spark, {
        "native_objects": table(spark, "native_objects", [{"native_object_index": i, "size_bytes": 1} for i in (0, 1, 1)]),
        "connections": table(spark, "connections", [{"from_kind": "native_object", "from_index": 0, "to_kind": "native_object", "to_index": 9}, {"from_kind": "odd", "from_index": 0, "to_kind": "managed_object", "to_index": 0}]),
        "native_allocations": table(spark, "native_allocations", [{"allocation_index": 0, "memory_region_index": 4}]),
        "memory_regions": table(spark, "memory_regions", [{"region_index": 1, "first_allocation_index": 7}]),
    })
    got = {r.check_name: r.offending for r in quality.validate(t, "full", {"native_objects": 3}).collect()}
    assert got == {
        "duplicate/native_objects": 1, "orphan/to_native_object": 1, "orphan/to_managed_object": 1, "unknown_kind": 1, "orphan/allocation_region": 1, "orphan/region_first_allocation": 1,
        "rows/connections": 2, "rows/memory_regions": 1, "rows/native_allocations": 1,
    }
    assert quality.validate(t, "none", {}).count() == 0


def test_types_and_duplicates_of_small_tables(spark):
    rows = [("Mesh", "m", 100, False), ("Texture2D", "a", 300, False), ("Texture2D", "b", 500, False), ("Texture2D", "c", 9999, True), ("", "", 25, False), ("", "", 25, False), ("", None, 1, True)]
    t = Snapshot(spark, {"native_objects": table(spark, "native_objects", [{"native_object_index": i, "native_type_name": k, "name": n, "size_bytes": z, "is_destroyed": d} for i, (k, n, z, d) in enumerate(rows)])})
    assert [tuple(r) for r in reports.object_categories(t).collect()] == [("Texture2D", 800, 2), ("Mesh", 100, 1), ("(unknown)", 50, 2)]
    assert [(r.name, r.duplicate_count) for r in reports.duplicates(t).collect()] == [("", 2)]
    assert reports.duplicates(t, empty_as_null=True).count() == 0


def test_sessions_and_names(spark):
    rows = [("MyGame_2026-05-13_10-53-31_IOS_U63", 0, "format:17", "t2"), ("mygame_2026-05-13_10-59-59_ios_u63", None, "format:17", "t3"), ("MyGame_2026-05-13_10-28-31", None, "format:17", "t1"), ("MyGame_2026-05-13_14-30-06", None, "format:17", None), ("MyGame_2026-05-13_10-28-31x", None, "format:16", "t4"), ("a", 7, "x", "t5"), ("b", 7, "y", "t0")]
    df = spark.createDataFrame(rows, "snapshot_id string, session_guid long, version string, captured_at string").selectExpr("*", "cast(null as string) product_name", "'Android 12' platform")
    got = {r.snapshot_id: r for r in multi.sessions(df).collect()}
    # A capture of unknown time comes first, names count in any case of letters.
    assert got[rows[3][0]].session_no == 1 and got["a"].session_no == got["b"].session_no == 2 and got["a"].representative == "b"
    assert got[rows[0][0]].session_no == got[rows[1][0]].session_no == 4 and got[rows[2][0]].session_no == 3 and got[rows[4][0]].session_no == 5
    assert got[rows[0][0]].session_key == "mygame|2026-05-13|ios_u63|format:17" and got[rows[0][0]].title == "Session 4 · MyGame · Android · Snap format 17"
    names = spark.createDataFrame([("a b",), ("a/b",), ("A_b",), ("c",)], "name string")
    files = [r.file_name.lower() for r in multi.safe_names(names).collect()]
    assert len(set(files)) == 4 and "c" in files


def test_capture_titles(spark):
    rows = [("MyGame_2026-05-13_10-53-31_IOS_U63", "format:17"), ("MyGame_2026-05-13_10-28-31", "format:17"), ("plain", "x"), ("2026-05-13_10-28-31", ""), ("a_2026-05-13_10-28-31x", "format:")]
    df = spark.createDataFrame(rows, "name string, version string")
    got = [r[0] for r in df.select(multi.capture_title(df.name, df.version)).collect()]
    assert got == ["MyGame · 2026-05-13 · iOS U63 · Snap format 17", "MyGame · 2026-05-13 · 10:28:31 · General capture · Snap format 17", "plain · General capture · x", "2026-05-13_10-28-31 · General capture", "a_2026-05-13_10-28-31x · General capture"]


def test_session_keys(spark):
    rows = [("G_2026-05-13_10-28-31", "format:17"), ("G_2026-05-13_14-30-06", "format:17"), ("G_2026-05-13_10-53-31_IOS_U63", "format:17"), ("G_2026-05-13_11-00-00_IOS_U63", "format:17"), ("G_2026-05-13_10-28-31", "format:16"), ("x", "")]
    df = spark.createDataFrame(rows, "name string, version string")
    got = [r[0] for r in df.select(multi.session_key(df.name, df.version)).collect()]
    # A context holds captures of a day together, the time keeps those without one apart.
    assert got == ["G|2026-05-13|10-28-31|format:17", "G|2026-05-13|14-30-06|format:17", "G|2026-05-13|IOS_U63|format:17", "G|2026-05-13|IOS_U63|format:17", "G|2026-05-13|10-28-31|format:16", "x|_general|unknown"]


def test_metadata_falls_back_to_the_capture_and_the_name(spark):
    ddl = "snapshot_id string, session_guid long, product_name string, platform string, engine_version string, snap_format_version int, record_date_utc string"
    info = spark.createDataFrame([("a_2026-05-13_10-28-31", 0, " ", None, "format:12", 0, None), ("b", 7, "P", "Android", "2022.1", 17, "2022-09-28T22:13:20+00:00"), ("c_2026-05-13_10-28-31", 0, None, None, "format:12", 0, None)], ddl)
    files = spark.createDataFrame([("a_2026-05-13_10-28-31", 9, "Game", "IPhonePlayer", "2023.2", 18, "2024-01-02T03:04:05+00:00"), ("b", 8, "Q", "x", "y", 1, None)], ddl)
    got = {r.snapshot_id[0]: r for r in multi.enriched(info, files).collect()}
    assert tuple(got["a"])[1:5] == (9, "Game", "IPhonePlayer", "2023.2") and str(got["a"].captured_at) == "2024-01-02 03:04:05"
    assert tuple(got["b"])[1:5] == (7, "P", "Android", "2022.1") and tuple(got["c"])[1:5] == (0, None, None, "format:12") and str(got["c"].captured_at) == "2026-05-13 10:28:31"
    titles = {r.snapshot_id[0]: (r.session_no, r.title) for r in multi.sessions(multi.enriched(info, files)).collect()}
    assert titles == {"b": (1, "Session 1 · P · Android · 2022.1"), "a": (2, "Session 2 · Game · iOS · 2023.2"), "c": (3, "Session 3 · c · Snap format 12")}


def test_null_aware_sums_and_drift(spark):
    old = spark.createDataFrame([(1,)], "a int")
    both = multi.unioned({"x": old.selectExpr("a", "cast(5 as long) b"), "y": old}).groupBy("snapshot_id").agg(multi.null_aware_sum("b").alias("b"))
    assert {r.snapshot_id: r.b for r in both.collect()} == {"x": 5, "y": None}


def test_reports_render(spark):
    t = from_star(spark, "/root/testdata/sf0.001")
    page = render.report_html(t, "a <b>")
    assert page.count("<table>") >= 25 and "a &lt;b&gt;" in page and "five largest native types" in page and "would free" in page
    text = render.summary_text(snapshot(spark), (1, 1))
    assert "Schema      : 1.1" in text and "—" in text and "10,000,000 B" in text
    assert "export the capture again" in render.summary_text(t)


def test_views_answer_ad_hoc_sql(spark):
    t = from_star(spark, "/root/testdata/sf0.001")
    views.register(t)
    for page in (None, 4096):
        call = "region_page_density('BUILDING')" if page is None else f"region_page_density('BUILDING', {page}L)"
        assert [tuple(r) for r in spark.sql(f"select * from {call}").collect()] == [tuple(r) for r in views.region_page_density(t, "BUILDING", page).collect()]
    assert spark.sql("select * from region_page_density('no such')").first().touched_bytes is None
    asked = views.ask(t, "select count(*) n from native_objects where native_type_name = :kind and size_bytes > :least", kind="AssetBundle", least=1000)
    assert asked.first().n == t.native_objects.where("native_type_name = 'AssetBundle' and size_bytes > 1000").count()
    assert spark.sql("select count(*) n from region_allocations('BUILDING')").first().n == spark.sql("select count(*) n from v_allocation_enriched where system_region_name = 'BUILDING'").first().n


def test_export_store_validate_and_stream(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "one.snap").write_bytes(heap_file())
    assert cli.export(spark, str(folder), out, level="full") == 0
    assert cli.export(spark, str(folder), out, "nothing") == 2
    t = store.read(spark, f"{out}/one")
    assert store.version_of(t) == (1, 3) and t.managed_objects.count() == 4 and t.summary_metrics.count() == 9
    assert store.up_to_date(spark, str(folder / "one.snap"), f"{out}/one")
    store.set_version(spark, f"{out}/one", 1, 1)
    assert store.upgrade(spark, f"{out}/one") == "upgrade_in_place" and store.upgrade(spark, f"{out}/one") == "none"
    wanted = tmp_path / "g.json"
    wanted.write_text(json.dumps({"nativeTypeMetrics": [{"nativeTypeName": "AssetBundle", "count": 2}]}))
    assert cli.validate(spark, str(wanted), f"{out}/one") == 1 and cli.validate(spark, str(tmp_path / "no.json"), out) == 3
    assert json.loads((tmp_path / "g_validation_result.json").read_text())["Passed"] is False
    assert cli.report(spark, f"{out}/one", str(tmp_path / "r.html")) == 0 and cli.multi_report(spark, [f"{out}/one", str(tmp_path)], str(tmp_path / "m.html")) == 0
    query = type_sizes(follow(spark, out, "native_objects")).writeStream.outputMode("complete").format("memory").queryName("sizes").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.sql("select * from sizes").collect()] == [("one", "GameObject", 1, 64)]


@pytest.mark.parametrize(("column", "want"), [("total_mb", "Total (MB)"), ("obj_count", "Obj count"), ("utilization_pct", "Utilization (%)")])
def test_titles(column, want):
    assert render.title_of(column) == want
