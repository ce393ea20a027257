"""Reports as HTML and text. Only the small result tables of the report queries are collected."""

from __future__ import annotations

import html
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from heaplens.catalog import Snapshot
from heaplens.plans import multi, reports, views
from heaplens.schema import describe

#: Groups of a report, and the sections of each as title and query.
GROUPS = {
    "Native objects": {"Overview": reports.native_overview, "Types": reports.native_types, "Sizes": reports.size_buckets, "Largest objects": reports.top_native, "Largest 50": reports.top50_summary},
    "Duplicates": {"Summary": reports.duplicate_summary, "Groups": reports.duplicates},
    "Managed objects": {"Overview": reports.managed_overview, "Types": reports.managed_types},
    "Leaks": {
        "Both patterns": reports.leaked_combined, "Destroyed but in memory": reports.leaked_a_stats, "Destroyed by type": reports.leaked_a_types, "Ranking by what would be freed": reports.leak_ranking,
        "All destroyed": reports.destroyed_types, "All destroyed, summary": reports.destroyed_stats, "Orphaned wrappers": reports.leaked_b_types,
    },
    "Roots": {"Areas": reports.roots_by_area, "Largest roots": reports.roots_top},
    "Memory": {"Regions": reports.region_parents, "Allocation efficiency": reports.alloc_efficiency},
    "References": {"Edge types": reports.conn_types, "Most referenced": reports.most_referenced, "Most referenced without scripts": reports.most_referenced_excl, "Most outbound": reports.most_outbound},
}
#: Sections that need to know which objects are destroyed.
DESTROYED = {"Both patterns", "Destroyed but in memory", "Destroyed by type", "Ranking by what would be freed", "All destroyed", "All destroyed, summary"}
#: Titles of the groups of metrics.
GROUP_TITLES = {"Totals": "Total", "AllocatedMemoryDistribution": "Allocated memory", "ManagedHeapUtilization": "Managed heap"}
STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px}td.n{text-align:right}th{cursor:pointer;background:#eee}"
SORT = """document.querySelectorAll('th').forEach(h=>h.onclick=()=>{const t=h.closest('table'),i=[...h.parentNode.children].indexOf(h),d=h.dataset.d=h.dataset.d==='1'?'-1':'1';
[...t.tBodies[0].rows].sort((a,b)=>{const x=a.cells[i].dataset.v,y=b.cells[i].dataset.v;return d*(isNaN(x)||isNaN(y)?x.localeCompare(y):x-y)}).forEach(r=>t.tBodies[0].append(r))})"""


def title_of(column: str) -> str:
    """`total_mb` reads as `Total (MB)`."""
    for suffix, unit in (("_mb", "MB"), ("_gb", "GB"), ("_kb", "KB"), ("_pct", "%"), ("_bytes", "bytes")):
        if column.endswith(suffix):
            return f"{column.removesuffix(suffix).replace('_', ' ').capitalize()} ({unit})"
    return column.replace("_", " ").capitalize()


def cell(column: str, x: object) -> str:
    if x is None:
        return "—"
    if isinstance(x, bool) or isinstance(x, str):
        return str(x)
    if isinstance(x, float):
        return f"{x:,.2f}" + ("%" if column.endswith("_pct") or column.startswith("pct_") else "")
    return f"{x:,}"


def table_html(df: DataFrame) -> str:
    """All rows; queries with a limit have it of their own."""
    head = "".join(f"<th>{html.escape(title_of(c))}</th>" for c in df.columns)
    line = lambda r: "".join(f'<td{"" if isinstance(x, str) else " class=n"} data-v="{html.escape(str("" if x is None else x))}">{html.escape(cell(c, x))}</td>' for c, x in zip(df.columns, r, strict=True))
    return f"<table><thead><tr>{head}</tr></thead><tbody>{''.join(f'<tr>{line(r)}</tr>' for r in df.toLocalIterator())}</tbody></table>"


def number(x: object, unit: str = "") -> str:
    return "—" if x is None else (f"{x:,}" if isinstance(x, int) else f"{x:,.2f}") + unit


def native_insight(t: Snapshot) -> str:
    o = reports.native_overview(t).first()
    return f"{number(o.total_objects)} native objects of {number(o.distinct_types)} types hold {number(o.total_native_mb, ' MB')}: {number(o.avg_size_kb, ' KB')} on average, {number(o.max_single_object_mb, ' MB')} at most."


def types_insight(t: Snapshot) -> str:
    names = [r.type_name for r in reports.native_types(t).limit(5).collect()]
    share = reports.top5_pct(t).first().top5_pct
    return f"The five largest native types ({', '.join(names)}) hold {share:.1f}% of native object bytes." if share is not None else ""


def largest_insight(t: Snapshot) -> str:
    o = reports.top50_summary(t).first()
    return f"The {number(o.obj_count)} largest objects hold {number(o.total_mb, ' MB')}, {number(o.pct_of_native_total)}% of all native bytes."


def duplicates_insight(t: Snapshot) -> str:
    o = reports.duplicate_summary(t).first()
    return f"{number(o.duplicate_groups)} groups of equal names and types waste up to {number(o.total_wasted_mb, ' MB')}, {number(o.pct_of_native_total)}% of native bytes." if o.duplicate_groups else ""


def managed_insight(t: Snapshot) -> str:
    o = reports.managed_overview(t).first()
    return f"{number(o.total_objects)} managed objects of {number(o.distinct_types)} types hold {number(o.total_managed_mb, ' MB')}; {number(o.objects_with_native_ref)} stand for native objects."


def managed_types_insight(t: Snapshot) -> str:
    top = reports.managed_types(t).first()
    return f"{top.type_name} holds most of the managed heap: {number(top.total_mb, ' MB')}." if top else ""


def leaks_insight(t: Snapshot) -> str:
    a, b = reports.leaked_a_stats(t).first(), reports.leaked_b_stats(t).first()
    return f"{number(a.total_leaked_count)} wrappers keep destroyed objects ({number(a.native_mb_retained or 0.0, ' MB')}); {number(b.total_orphaned)} wrappers have lost theirs." if a.total_leaked_count or b.total_orphaned else ""


def pairs_insight(t: Snapshot) -> str:
    top = reports.leaked_a_types(t).first()
    return f"Of the pairs of types with destroyed objects, {top.native_type} kept by {top.managed_type} holds most: {number(top.native_mb_retained, ' MB')}." if top else ""


def ranking_insight(t: Snapshot) -> str:
    top = reports.leak_ranking(t).first()
    return f"Freeing {top.name} would free {number(top.total_freed_mb, ' MB')}: {number(top.own_size_mb, ' MB')} of its own and {number(top.exclusive_mb, ' MB')} that nothing else holds." if top else ""


def destroyed_insight(t: Snapshot) -> str:
    o = reports.destroyed_stats(t).first()
    return f"{number(o.total_destroyed)} objects are destroyed and still in memory, with {number(o.native_mb_retained or 0.0, ' MB')}; those that a wrapper keeps are a part of them." if o.total_destroyed else ""


def orphans_insight(t: Snapshot) -> str:
    n, top = reports.leaked_b_stats(t).first().total_orphaned, reports.leaked_b_types(t).first()
    return f"{number(n)} wrappers have lost their native object, most of them {top.managed_type} ({number(top.leaked_count)})." if top else ""


#: What stands out in a section, as a sentence above its table.
INSIGHTS = {
    reports.native_overview: native_insight, reports.native_types: types_insight, reports.top50_summary: largest_insight, reports.duplicate_summary: duplicates_insight, reports.managed_overview: managed_insight,
    reports.managed_types: managed_types_insight, reports.leaked_combined: leaks_insight, reports.leaked_a_types: pairs_insight, reports.leak_ranking: ranking_insight, reports.destroyed_types: destroyed_insight,
    reports.leaked_b_types: orphans_insight,
}


def source_html(t: Snapshot) -> str:
    """Where the snapshot comes from, and how many rows its tables have."""
    info, version, counts = reports.snapshot_info(t).first(), reports.schema_meta(t).first(), reports.table_counts(t)
    known = {"Snapshot": info.snapshot_path, "Exported": info.exported_at_utc, "Engine": info.engine_version} if info else {}
    known |= {"Schema": describe(*version) if version else describe(0, 0), "Rows": number(sum(r.row_count for r in counts.collect()))}
    lines = "".join(f"<tr><th>{html.escape(k)}</th><td>{html.escape(str(v or '—'))}</td></tr>" for k, v in known.items())
    return f"<table>{lines}</table>{table_html(counts)}"


def report_html(t: Snapshot, title: str = "Heap snapshot") -> str:
    """A self-contained page. Without is_destroyed, a note takes the place of the sections that need it."""
    known = not t.tables or t.has_column("native_objects", "is_destroyed")
    nav, body = "", f"<h2 id=source>Source</h2>{source_html(t)}"
    for g, sections in GROUPS.items():
        anchor = g.lower().replace(" ", "-")
        nav += f'<a href="#{anchor}">{html.escape(g)}</a> '
        body += f'<h2 id="{anchor}">{html.escape(g)}</h2>'
        if g == "Leaks" and not known:
            body += "<p>This store does not tell which objects are destroyed: export the capture again to have the other sections.</p>"
        for s, q in sections.items():
            if known or s not in DESTROYED:
                said = INSIGHTS[q](t) if q in INSIGHTS else ""
                body += f"<h3>{html.escape(s)}</h3>" + (f"<p>{html.escape(said)}</p>" if said else "") + table_html(q(t))
    bundles = views.v_assetbundle_utilization(t).orderBy("native_object_index")
    body += f"<h2 id=bundles>Asset bundles</h2>{table_html(bundles)}<h3>Loaded types</h3>{table_html(views.bundle_mix(t).orderBy('asset_type_name'))}<h3>In several bundles</h3>{table_html(views.shared_assets(t).orderBy('asset_index'))}"
    nav = f'<p><a href="#source">Source</a> {nav}<a href="#bundles">Asset bundles</a></p>'
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{nav}{body}<script>{SORT}</script></body></html>"


def grouped_html(df: DataFrame, groups: list[tuple[str, list[str]]], links: dict[str, str]) -> str:
    """A table whose columns stand under the names of their groups; snapshots link to their reports."""
    cols = [c for _, cs in groups for c in cs]
    top = "".join(f'<th colspan={len(cs)}>{html.escape(g)}</th>' for g, cs in groups)
    head = "".join(f"<th>{html.escape(title_of(c))}</th>" for c in cols)
    body = ""
    for r in df.select(*cols).toLocalIterator():
        body += "<tr>"
        for c in cols:
            text = html.escape(cell(c, r[c]))
            shown = f'<a href="{html.escape(links[r[c]])}">{text}</a>' if c == "snapshot_id" and r[c] in links else text
            body += f'<td{"" if isinstance(r[c], str) else " class=n"} data-v="{html.escape(str("" if r[c] is None else r[c]))}">{shown}</td>'
        body += "</tr>"
    return f"<table><thead><tr>{top}</tr><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def multi_html(metrics: DataFrame, sessions: DataFrame, tracked: DataFrame, links: dict[str, str] | None = None) -> str:
    """Snapshots side by side, in blocks of sessions under their titles, with links to reports of their own."""
    wide = sessions.join(multi.pivoted(metrics), "snapshot_id", "left")
    groups: dict[str, list[str]] = {"Snapshot": ["snapshot_id"]}
    for g, c in multi.PIVOT:
        groups.setdefault(GROUP_TITLES[g], []).extend(f"{multi.column_name(c)}_{x}" for x in ("committed", "resident"))
    parts = "<h1>Snapshots</h1>"
    for s in sessions.select("session_no", "title").distinct().orderBy("session_no").collect():  # one row per session
        mine = wide.where(wide.session_no == s.session_no).orderBy("snapshot_id")
        parts += f"<h2>{html.escape(s.title)}</h2>{grouped_html(mine, list(groups.items()), links or {})}"
    parts += f"<h2>Tracked types</h2>{table_html(tracked.orderBy('snapshot_id', 'tracked'))}"
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><style>{STYLE}</style></head><body>{parts}<script>{SORT}</script></body></html>"


def human(n: int) -> str:
    x, unit = float(n), "B"
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if abs(x) < 1024 or unit == "TB":
            break
        x /= 1024
    return f"{n:,} B" if unit == "B" else f"{x:,.2f} {unit} ({n:,} B)"


def summary_text(t: Snapshot, version: tuple[int, int] = (0, 0)) -> str:
    """The console summary of a snapshot."""
    info, rows = t.snapshot_info.first(), t.summary_metrics.collect()
    out = [f"Snapshot    : {info.snapshot_path if info else '—'}", f"Schema      : {describe(*version)}", f"Printed     : {datetime.now(UTC):%Y-%m-%d %H:%M:%S} UTC"]
    if info:
        platform = {"IPhonePlayer": "iOS (IPhonePlayer)"}.get(info.platform, info.platform or "—")
        out += [f"Product     : {info.product_name or '—'}", f"Platform    : {platform}", f"Format      : v{info.snap_format_version or 0}"]
    if not rows:
        return "\n".join([*out, "No summary metrics: export the capture again to have them."])
    for group in dict.fromkeys(r.metric_group for r in rows):
        out += ["", group]
        for r in (r for r in rows if r.metric_group == group):
            out.append(f"  {r.category:<24}{human(r.committed_bytes):>40}{human(r.resident_bytes) if r.resident_available else '—':>40}")
    types = reports.object_categories(t, 12).collect()
    out += ["", "Largest types", *(f"  {r.type_name:<24}{human(r.total_bytes):>40}{r.obj_count:>12,}" for r in types)]
    return "\n".join(out)
