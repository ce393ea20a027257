"""Command line: export, report, multi-report, summary, sql, validate, upgrade."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heaplens.catalog import Snapshot
from heaplens.operators import sweep
from heaplens.operators.residency import resident_spans
from heaplens.plans import golden, multi, quality, render, summary, views
from heaplens.schema import describe, evaluate
from heaplens.sources import captures, store


def _session() -> SparkSession:
    return SparkSession.builder.appName("heaplens").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _metrics(t: Snapshot, name: str) -> DataFrame:
    """The summary metrics of a decoded capture: spans with their resident bytes, on the capture's platform."""
    info, stats = t.snapshot_info.first(), t.target_stats.first()
    spans = sweep.nested_spans(summary.intervals(t, t.heap_sections, name))
    spans = resident_spans(spans, t.page_runs.withColumn("snapshot_id", F.lit(name)))
    spans = summary.classified(t, spans, t.heap_sections, "android" in (info.platform or "").lower())
    return summary.summary_metrics(spans, not t.system_memory_regions.isEmpty(), summary.TargetStats(stats.graphics_used, stats.total_virtual) if stats else None)


def export(spark: SparkSession, folder: str, out: str, name_filter: str = "", level: str = "minimal", force: bool = True) -> int:
    """Every capture of a folder to a store of its own below out. 0 if all is well, 1 if a check fails, 2 if none is found.

    Without force, captures whose store is no older are not even decoded. The rows that are expected in a store
    are those that the decoder counted.
    """
    names = captures.capture_names(spark, folder, name_filter)
    wanted = [n for n in names if force or not store.up_to_date(spark, f"{folder}/{n}.snap", f"{out}/{n}")]
    bad = 0
    for name in captures.extract(spark, folder, f"{out}/_decoded", name_filter, wanted) if wanted else []:
        target = f"{out}/{name}"
        t = captures.load(spark, f"{out}/_decoded", name)
        t.tables["summary_metrics"] = _metrics(t, name)
        expected = {r.table_name: r.rows for r in t.row_counts.collect()}
        failing = quality.strict(t).where("offending > 0").collect() if level == "full" else []
        for extra in captures.EXTRA:
            del t.tables[extra]
        store.write(t, target)
        failing += quality.validate(store.read(spark, target), level, expected).collect()
        bad += len(failing)
        for r in failing:
            print(f"{name}: {r.check_name}: {r.offending}", file=sys.stderr)
    return 2 if not names else int(bad > 0)


def report(spark: SparkSession, folder: str, out: str) -> int:
    t = store.read(spark, folder)
    version = store.version_of(t)
    if evaluate(*version) != "none":
        print(f"note: schema {describe(*version)}", file=sys.stderr)
    with open(out, "w", encoding="utf-8") as f:
        f.write(render.report_html(t, folder.rstrip("/").rsplit("/", 1)[-1]))
    return 0


def multi_report(spark: SparkSession, folders: list[str], out: str, name_filter: str = "", reports: bool = True) -> int:
    """One page on many stores, and unless told otherwise a report of each beside it. 2 if there is no store.

    folders: stores, or folders with stores in them.
    """
    parts, known = {}, {}
    for path in [p for f in folders for p in store.discover(spark, f, name_filter)]:
        name = path.rsplit("/", 1)[-1]
        try:
            t = store.read(spark, path)
            if t.tables:
                parts[name], known[name] = t, path
        except Exception as e:  # a damaged store must not hide the others
            print(f"{path}: {e}", file=sys.stderr)
    if not parts:
        return 2
    all_ = lambda name: multi.unioned({k: getattr(t, name) for k, t in parts.items()})
    files = []
    for name, path in known.items():
        try:
            meta = captures.header_of(f"{path}.snap")
        except ValueError as e:
            print(f"{path}.snap: {e}", file=sys.stderr)
            continue
        if meta:
            files.append((name, *[meta[c] for c in ("session_guid", "product_name", "platform", "engine_version", "snap_format_version", "record_date_utc")]))
    beside = spark.createDataFrame(files, "snapshot_id string, session_guid long, product_name string, platform string, engine_version string, snap_format_version int, record_date_utc string")
    info = spark.createDataFrame([(n,) for n in parts], "snapshot_id string").join(all_("snapshot_info"), "snapshot_id", "left")
    links = {}
    if reports:
        base = out.removesuffix(".html") + "_reports"
        os.makedirs(base, exist_ok=True)
        for r in multi.safe_names(spark.createDataFrame([(n,) for n in parts], "name string")).collect():
            report(spark, known[r.name], f"{base}/{r.file_name}.html")
            links[r.name] = f"{os.path.basename(base)}/{r.file_name}.html"
    page = render.multi_html(all_("summary_metrics"), multi.sessions(multi.enriched(info, beside)), multi.tracked(all_("native_objects"), all_("native_roots")), links)
    with open(out, "w", encoding="utf-8") as f:
        f.write(page)
    return 0


def validate(spark: SparkSession, golden_path: str, folder: str, out: str | None = None) -> int:
    """0 if the store agrees with the golden values, 1 if not, 3 on errors."""
    try:
        with open(golden_path, encoding="utf-8-sig") as f:
            wanted = json.load(f)
        failures = golden.compare(store.read(spark, folder), wanted)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 3
    with open(out or golden_path.removesuffix(".json") + "_validation_result.json", "w", encoding="utf-8") as f:
        f.write(golden.result_json(wanted, golden_path, folder, failures))
    print("\n".join(failures) or "passed")
    return int(bool(failures))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="heaplens", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("export")
    e.add_argument("folder")
    e.add_argument("out")
    e.add_argument("--filter", default="")
    e.add_argument("--validate", choices=("none", "minimal", "full"), default="minimal")
    e.add_argument("--skip-existing", action="store_true")
    for name, args in (("report", ("store", "out")), ("summary", ("store",)), ("upgrade", ("store",)), ("validate", ("golden", "store"))):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
    q = sub.add_parser("sql")
    q.add_argument("store")
    q.add_argument("statement")
    q.add_argument("--arg", action="append", default=[], metavar="NAME=VALUE")
    m = sub.add_parser("multi-report")
    m.add_argument("out")
    m.add_argument("stores", nargs="+")
    m.add_argument("--filter", default="")
    m.add_argument("--no-reports", action="store_true")
    a, spark = p.parse_args(argv), _session()
    if a.command == "export":
        return export(spark, a.folder, a.out, a.filter, a.validate, not a.skip_existing)
    if a.command == "report":
        return report(spark, a.store, a.out)
    if a.command == "multi-report":
        return multi_report(spark, a.stores, a.out, a.filter, not a.no_reports)
    if a.command == "validate":
        return validate(spark, a.golden, a.store)
    if a.command == "upgrade":
        print(store.upgrade(spark, a.store))
        return 0
    t = store.read(spark, a.store)
    if a.command == "sql":
        for row in views.ask(t, a.statement, **dict(x.split("=", 1) for x in a.arg)).toLocalIterator():
            print(*("" if x is None else x for x in row), sep="\t")
        return 0
    print(render.summary_text(t, store.version_of(t)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
