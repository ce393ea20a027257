"""The same queries in SQL over the star-schema tables, for another engine to check the results against."""

from __future__ import annotations

from heaplens.catalog import STAR, star_prefix
from heaplens.plans.multi import PIVOT, column_name

_R = lambda x, n: f"round(({x}) * 1e{n}) / 1e{n}"
_MB = lambda x, n=2: _R(f"({x}) / 1048576e0", n)
_PCT = lambda a, b, n=1: _R(f"1e2 * ({a}) / nullif({b}, 0)", n)
_SUM = lambda c: f"cast(sum({c}) as bigint)"
_TYPE = "coalesce(native_type_name, '(unknown)')"
_NATIVE = "(select sum(size_bytes) from native_objects)"

_TYPES = lambda table, c: f"""with g as (select {c} t, count(*) n, sum(size_bytes) b from {table} group by {c})
    select coalesce(t, '(unknown)') type_name, n obj_count, {_MB("b")} total_mb, {_PCT("b", "(select sum(b) from g)", 2)} pct_of_total from g order by total_mb desc, type_name limit 40"""  # noqa: E731
_DUPS = """select name, native_type_name, count(*) n, min(size_bytes) low, max(size_bytes) high, sum(size_bytes) b, (count(*) - 1) * (cast(sum(size_bytes) as double) / count(*)) wasted
    from native_objects where name is not null group by name, native_type_name having count(*) > 1"""
_DEGREE = lambda side, name, more="": f"""select o.native_object_index, coalesce(o.name, '(unnamed)') as name, coalesce(o.native_type_name, '(unknown)') type_name, {_MB("o.size_bytes")} size_mb, count(*) {name}
    from connections c join native_objects o on o.native_object_index = c.{side}_index where c.{side}_kind = 'native_object' {more}
    group by o.native_object_index, o.name, o.native_type_name, o.size_bytes order by {name} desc, o.native_object_index limit 20"""  # noqa: E731
_PAIRS = "managed_objects m join native_objects o on m.native_object_index = o.native_object_index where o.is_destroyed"
_ORPHANS = "managed_objects m where m.native_object_index is null and m.managed_type_name in (select managed_type_name from managed_objects where native_object_index is not null)"
_REFS = """select distinct c.from_index src, c.to_index dst from connections c join native_objects b on b.native_object_index = c.from_index and b.native_type_name = 'AssetBundle'
    where c.from_kind = 'native_object' and c.to_kind = 'native_object' and c.connection_type = 'native_connection' and c.to_index <> c.from_index"""
_ENRICHED = """select a.allocation_index, a.address, a.size_bytes, a.overhead_size_bytes, a.padding_size_bytes, a.memory_region_index, mr.name unity_region_name,
    case when a.address < s.address + s.size_bytes then s.region_index end system_region_index, case when a.address < s.address + s.size_bytes then s.name end system_region_name,
    a.root_reference_id, rt.area_name, rt.object_name root_object_name, o.native_object_index, o.native_type_name, o.name object_name
    from native_allocations a asof left join system_memory_regions s on a.address >= s.address left join memory_regions mr on mr.region_index = a.memory_region_index
    left join native_roots rt on rt.root_id = a.root_reference_id left join native_objects o on o.root_reference_id = a.root_reference_id"""
_LOADED = f"""select b.native_object_index bundle_index, b.name bundle_name, b.size_bytes bundle_size_bytes, b.resident_size_bytes bundle_resident_bytes, o.native_object_index asset_index,
    o.name asset_name, o.native_type_name asset_type_name, o.size_bytes asset_size_bytes, o.resident_size_bytes asset_resident_bytes, o.is_destroyed asset_is_destroyed
    from ({_REFS}) r join native_objects b on b.native_object_index = r.src join native_objects o on o.native_object_index = r.dst"""
_INSIDE = "a.address >= s.address and a.address < s.address + s.size_bytes"
_EDGES = "select distinct from_index src, to_index dst from connections where from_kind = 'native_object' and to_kind = 'native_object' and connection_type = 'native_connection'"
_LEAK_TOP = f"""select o.native_object_index, coalesce(o.name, '(unnamed)') as name, coalesce(o.native_type_name, '(unknown)') native_type, coalesce(m.managed_type_name, '(unknown)') managed_type,
    {_MB("o.size_bytes")} own_size_mb from {_PAIRS} order by o.size_bytes desc, o.native_object_index, m.managed_object_index limit 20"""
_DOWN = f"""with recursive edges as ({_EDGES}), roots as (select distinct cast(native_object_index as bigint) root from ({_LEAK_TOP})),
    reach as (select root, dst node from roots join edges on src = root union select r.root, e.dst from reach r join edges e on e.src = r.node),
    outside as (select distinct r.root, r.node from reach r join edges e on e.dst = r.node where e.src <> r.root and not exists (select 1 from reach x where x.root = r.root and x.node = e.src)),
    sized as (select r.root, r.node, n.size_bytes, (r.root, r.node) in (select (root, node) from outside) as ext from reach r join native_objects n on n.native_object_index = r.node)
    select roots.root, coalesce({_MB("sum(size_bytes)")}, 0) downstream_mb, coalesce({_MB("sum(case when not ext then size_bytes end)")}, 0) exclusive_mb from roots left join sized on sized.root = roots.root group by roots.root"""
_ORPHAN = lambda side, kind, table, key: f"select 'orphan/{side}_{kind}' check_name, count(*) offending from connections c where {side}_kind = '{kind}' and not exists (select 1 from {table} o where o.{key} = c.{side}_index)"
_FLAT = """with p as (select 'region' source, cast(region_index as bigint) idx, address pos, 1 rnk from system_memory_regions
    union all select 'allocation', allocation_index, address, 2 from native_allocations where address <> 0 and size_bytes > 0
    union all select 'allocation', allocation_index, address + size_bytes, 0 from native_allocations where address <> 0 and size_bytes > 0
    union all select 'object', native_object_index, native_object_address, 3 from native_objects where native_object_address <> 0 and size_bytes > 0
    union all select 'object', native_object_index, native_object_address + size_bytes, 0 from native_objects where native_object_address <> 0 and size_bytes > 0),
    s as (select *, lead(pos) over w nxt, last_value(case when rnk = 1 then idx end ignore nulls) over w region from p window w as (order by pos, rnk, source, idx))
    select source, idx, region, pos address, nxt - pos size from s where rnk >= 2 and region is not null and nxt > pos"""

#: Region and page size of the parameterised queries.
REGION = "BUILDING"

SQL = {
    "table_counts": " union all ".join(f"select '{t}' table_name, count(*) row_count from {t}" for t in ("native_objects", "managed_objects", "connections", "native_roots", "memory_regions", "native_allocations")),
    "native_overview": f"""select count(*) total_objects, {_MB("sum(size_bytes)")} total_native_mb, {_R("sum(size_bytes) / 1073741824e0", 3)} total_native_gb,
        {_R("cast(sum(size_bytes) as double) / count(size_bytes) / 1024e0", 2)} avg_size_kb, {_MB("max(size_bytes)")} max_single_object_mb, count(distinct native_type_name) distinct_types from native_objects""",
    "native_types": _TYPES("native_objects", "native_type_name"),
    "managed_types": _TYPES("managed_objects", "managed_type_name"),
    "size_buckets": f"""select b log4_bucket, {_MB("power(4e0, b)", 3)} bucket_floor_mb, count(*) obj_count, {_MB("sum(size_bytes)")} total_mb
        from (select cast(floor(log(4, size_bytes)) as integer) b, size_bytes from native_objects where size_bytes > 0) group by b""",
    "top_native": f"select native_object_index, coalesce(name, '(unnamed)') as name, {_TYPE} type_name, {_MB('size_bytes', 3)} size_mb from native_objects order by size_bytes desc, native_object_index limit 50",
    "top5_pct": f"""select {_R("sum(pct)", 1)} top5_pct from (select {_PCT("sum(size_bytes)", _NATIVE, 2)} pct from native_objects group by native_type_name
        order by sum(size_bytes) desc, native_type_name asc nulls last limit 5)""",
    "duplicates": f"""select name, {_TYPE} type_name, n duplicate_count, {_MB("low", 3)} min_size_mb, {_MB("high", 3)} max_size_mb, {_MB("b", 3)} total_mb, {_MB("wasted", 3)} wasted_mb
        from ({_DUPS}) order by wasted_mb desc, name, type_name limit 50""",
    "duplicate_summary": f"""select count(*) duplicate_groups, cast(sum(n) - count(*) as bigint) extra_instances, {_MB("sum(wasted)")} total_wasted_mb, {_PCT("sum(wasted)", _NATIVE)} pct_of_native_total from ({_DUPS})""",
    "managed_overview": f"""select count(*) total_objects, {_MB("sum(size_bytes)")} total_managed_mb, {_R("cast(sum(size_bytes) as double) / count(size_bytes)", 0)} avg_size_bytes,
        count(distinct managed_type_name) distinct_types, count(native_object_index) objects_with_native_ref from managed_objects""",
    "roots_by_area": f"select coalesce(area_name, '(unknown)') as area_name, count(*) root_count, {_MB('sum(accumulated_size_bytes)')} total_accumulated_mb from native_roots group by native_roots.area_name",
    "roots_top": f"""select root_id, coalesce(area_name, '(unknown)') as area_name, coalesce(object_name, '(unnamed)') as object_name, {_MB("accumulated_size_bytes", 3)} accumulated_mb
        from native_roots order by accumulated_size_bytes desc, root_id limit 30""",
    "top50_summary": f"select count(*) obj_count, {_MB('sum(size_bytes)')} total_mb, {_PCT('sum(size_bytes)', _NATIVE)} pct_of_native_total from (select size_bytes from native_objects order by size_bytes desc limit 50)",
    "conn_types": "select connection_type, count(*) edge_count from connections group by connection_type",
    "most_referenced": _DEGREE("to", "inbound_refs"),
    "most_referenced_excl": _DEGREE("to", "inbound_refs", "and o.native_type_name <> 'MonoScript'"),
    "most_outbound": _DEGREE("from", "outbound_refs"),
    "region_parents": f"""select r.region_index, coalesce(r.name, '(unnamed)') region_name, coalesce(p.name, '—') parent_name, {_MB("r.address_size")} size_mb, r.num_allocations
        from memory_regions r left join memory_regions p on p.region_index = r.parent_region_index order by r.address_size desc, r.region_index limit 40""",
    "alloc_efficiency": f"""select region_name, num_allocations, region_size_mb, payload_mb, overhead_mb, padding_mb, utilization_pct from (select r.region_index, coalesce(r.name, '(unnamed)') region_name, r.num_allocations,
        {_MB("r.address_size")} region_size_mb, {_MB("sum(a.size_bytes)")} payload_mb, {_MB("sum(a.overhead_size_bytes)")} overhead_mb, {_MB("sum(a.padding_size_bytes)")} padding_mb, {_PCT("sum(a.size_bytes)", "r.address_size")} utilization_pct
        from memory_regions r left join native_allocations a on a.memory_region_index = r.region_index group by r.region_index, r.name, r.address_size, r.num_allocations having sum(a.size_bytes) is not null)
        order by payload_mb desc nulls last, region_index limit 30""",
    "leaked_a_stats": f"select count(*) total_leaked_count, {_MB('sum(o.size_bytes)')} native_mb_retained, {_PCT('sum(o.size_bytes)', _NATIVE)} pct_of_native_total from {_PAIRS}",
    "leaked_a_types": f"select coalesce(o.native_type_name, '(unknown)') native_type, coalesce(m.managed_type_name, '(unknown)') managed_type, count(*) leaked_count, {_MB('sum(o.size_bytes)')} native_mb_retained from {_PAIRS} group by 1, 2",
    "leaked_a_top": _LEAK_TOP,
    "leaked_b_types": f"select coalesce(m.managed_type_name, '(unknown)') managed_type, count(*) leaked_count from {_ORPHANS} group by 1",
    "leaked_b_stats": f"select count(*) total_orphaned from {_ORPHANS}",
    "leaked_combined": f"""select 'A: Destroyed (native still in memory)' pattern, coalesce(t, 'unknown (freed)') native_type_name, managed_type_name, n leaked_count, {_MB("b")} native_mb_retained
        from (select o.native_type_name t, m.managed_type_name, count(*) n, sum(o.size_bytes) b from {_PAIRS} group by 1, 2)
        union all select 'B: Orphaned (native freed)', 'unknown (freed)', m.managed_type_name, count(*), cast(0 as double) from {_ORPHANS} group by m.managed_type_name""",
    "destroyed_types": f"select {_TYPE} native_type, count(*) destroyed_count, {_MB('sum(size_bytes)')} native_mb_retained from native_objects where is_destroyed group by 1",
    "destroyed_stats": f"select count(*) total_destroyed, {_MB('sum(size_bytes)')} native_mb_retained, {_PCT('sum(size_bytes)', _NATIVE)} pct_of_native_total from native_objects where is_destroyed",
    "object_categories": f"select coalesce(nullif(native_type_name, ''), '(unknown)') type_name, {_SUM('size_bytes')} total_bytes, count(*) obj_count from native_objects where not is_destroyed group by 1",
    "v_allocation_enriched": _ENRICHED,
    "v_allocation_enriched_covering": f"""select a.allocation_index, s.system_region_index, s.system_region_name from native_allocations a left join (select a.allocation_index,
        arg_max(s.region_index, s.address) system_region_index, arg_max(s.name, s.address) system_region_name from native_allocations a join system_memory_regions s on {_INSIDE} group by 1) s using (allocation_index)""",
    "v_system_region_summary": f"""select s.region_index, s.name, printf('0x%x', s.address) addr_hex, s.size_bytes committed_bytes, s.resident_bytes, {_PCT("s.resident_bytes", "s.size_bytes")} pct_resident,
        count(a.allocation_index) unity_alloc_count, cast(coalesce(sum(a.size_bytes), 0) as bigint) unity_live_bytes, {_PCT("coalesce(sum(a.size_bytes), 0)", "s.resident_bytes")} unity_live_pct_of_resident
        from system_memory_regions s left join native_allocations a on {_INSIDE} group by s.region_index, s.name, s.address, s.size_bytes, s.resident_bytes""",
    "v_region_owner_breakdown": f"select system_region_name, coalesce(native_type_name, area_name, '(untracked/no-root)') as owner, count(*) alloc_count, {_SUM('size_bytes')} live_bytes from ({_ENRICHED}) group by 1, 2",
    "v_connection_edges": """select c.connection_type, c.from_kind, c.from_index, coalesce(fn.native_type_name, fm.managed_type_name) from_type, fn.name from_name, c.to_kind, c.to_index,
        coalesce(tn.native_type_name, tm.managed_type_name) to_type, tn.name to_name from connections c
        left join native_objects fn on fn.native_object_index = case when c.from_kind = 'native_object' then c.from_index end
        left join managed_objects fm on fm.managed_object_index = case when c.from_kind = 'managed_object' then c.from_index end
        left join native_objects tn on tn.native_object_index = case when c.to_kind = 'native_object' then c.to_index end
        left join managed_objects tm on tm.managed_object_index = case when c.to_kind = 'managed_object' then c.to_index end""",
    "v_assetbundle_utilization": f"""select b.native_object_index, b.name, b.size_bytes bundle_size_bytes, b.resident_size_bytes bundle_resident_bytes, b.is_destroyed, count(distinct r.dst) referenced_object_count,
        count(distinct o.native_type_name) referenced_type_count, cast(coalesce(sum(o.size_bytes), 0) as bigint) referenced_size_bytes, cast(coalesce(sum(o.resident_size_bytes), 0) as bigint) referenced_resident_bytes,
        count(distinct r.dst) > 0 references_loaded_assets from native_objects b left join ({_REFS}) r on r.src = b.native_object_index left join native_objects o on o.native_object_index = r.dst
        where b.native_type_name = 'AssetBundle' group by b.native_object_index, b.name, b.size_bytes, b.resident_size_bytes, b.is_destroyed""",
    "v_assetbundle_loaded_assets": _LOADED,
    "region_allocations": f"select * from ({_ENRICHED}) where system_region_name = '{REGION}'",
    "region_page_density": f"""select count(*) touched_pages, case when count(*) > 0 then count(*) * 16384 end touched_bytes, {_R("cast(sum(used) as double) / count(*)", 0)} avg_live_bytes_per_page,
        {_R("1e2 * (cast(sum(used) as double) / count(*)) / 16384e0", 1)} avg_fill_pct, {_R("cast(sum(n) as double) / count(*)", 1)} avg_allocs_per_page
        from (select a.address // 16384 page, sum(a.size_bytes) used, count(*) n from native_allocations a join system_memory_regions s on s.name = '{REGION}' and {_INSIDE} group by 1)""",
    "page_histogram": f"select address >> 14 page, count(*) alloc_count, {_SUM('size_bytes')} live_bytes from native_allocations group by 1",
    "bundle_mix": f"select asset_type_name, count(*) asset_refs, count(distinct asset_index) assets, {_SUM('asset_size_bytes')} bytes from ({_LOADED}) group by 1",
    "shared_assets": f"select asset_index, asset_name, count(distinct bundle_index) bundles from ({_LOADED}) group by 1, 2 having count(distinct bundle_index) > 1",
    "downstream_stats": _DOWN,
    "flat_sweep": _FLAT,
    "root_owned_bytes": f"""select root_id, {_SUM("size")} owned_bytes from (select f.size, coalesce(a.root_reference_id, o.root_reference_id) root_id from ({_FLAT}) f
        left join native_allocations a on f.source = 'allocation' and a.allocation_index = f.idx left join native_objects o on f.source = 'object' and o.native_object_index = f.idx) where root_id >= 1 group by root_id""",
    "page_residency": """select allocation_index, cast(coalesce(sum(least(address + size_bytes, (page + 1) * 4096) - greatest(address, page * 4096)) filter (page % 3 <> 0), 0) as bigint) resident_bytes
        from (select allocation_index, address, size_bytes, unnest(range(address // 4096, (address + size_bytes - 1) // 4096 + 1)) page from native_allocations where size_bytes > 0) group by allocation_index""",
    "golden_assetbundle": f"select count(*) obj_count, coalesce({_SUM('size_bytes')}, 0) allocated_bytes, coalesce({_SUM('resident_size_bytes')}, 0) resident_bytes from native_objects where native_type_name = 'AssetBundle' and not is_destroyed",
    "golden_serialized": f"select count(*) obj_count, coalesce({_SUM('accumulated_size_bytes')}, 0) allocated_bytes, coalesce({_SUM('resident_size_bytes')}, 0) resident_bytes from native_roots where lower(coalesce(area_name, '')) like '%serializedfile%'",
    "golden_remapper": f"""select area_name, object_name, coalesce({_SUM("accumulated_size_bytes")}, 0) allocated_bytes, coalesce({_SUM("resident_size_bytes")}, 0) resident_bytes from native_roots
        where object_name like '%Remapper%' or coalesce(area_name, '') || ':' || coalesce(object_name, '') like '%PersistentManager%Remapper%' group by area_name, object_name""",
    "dq_duplicates": " union all ".join(
        f"select 'duplicate/{t}' check_name, count(*) offending from (select {k} from {t} group by {k} having count(*) > 1)"
        for t, k in (("native_objects", "native_object_index"), ("managed_objects", "managed_object_index"), ("memory_regions", "region_index"), ("native_allocations", "allocation_index"))
    ),
    "dq_orphans": " union all ".join(
        [
            *(_ORPHAN(s, k, t, i) for s in ("from", "to") for k, t, i in (("native_object", "native_objects", "native_object_index"), ("managed_object", "managed_objects", "managed_object_index"))),
            "select 'unknown_kind', count(*) from connections where from_kind not in ('native_object', 'managed_object') or to_kind not in ('native_object', 'managed_object')",
            "select 'orphan/allocation_region', count(*) from native_allocations a where memory_region_index is not null and not exists (select 1 from memory_regions r where r.region_index = a.memory_region_index)",
            "select 'orphan/region_first_allocation', count(*) from memory_regions r where first_allocation_index is not null and not exists (select 1 from native_allocations a where a.allocation_index = r.first_allocation_index)",
        ]
    ),
    "multi_tracked": f"""select cast(snap as varchar) snapshot_id, 'AssetBundle' tracked, count(*) obj_count, {_SUM("size_bytes")} allocated_bytes, case when count(resident_size_bytes) = count(*) then {_SUM("resident_size_bytes")} end resident_bytes
        from (select *, native_object_index % 3 snap from native_objects) where native_type_name = 'AssetBundle' and not is_destroyed group by snap
        union all select cast(root_index % 3 as varchar), 'SerializedFile', count(*), {_SUM("accumulated_size_bytes")}, {_SUM("resident_size_bytes")} from native_roots where lower(area_name) like '%serializedfile%' group by root_index % 3
        union all select cast(root_index % 3 as varchar), 'Remapper', count(*), {_SUM("accumulated_size_bytes")}, {_SUM("resident_size_bytes")} from native_roots
        where object_name like '%Remapper%' or coalesce(area_name, '') || ':' || coalesce(object_name, '') like '%PersistentManager%Remapper%' group by root_index % 3""",
    "leak_ranking": f"""select top.*, d.downstream_mb, d.exclusive_mb, round_even(top.own_size_mb + d.exclusive_mb, 2) total_freed_mb from ({_LEAK_TOP}) top join ({_DOWN}) d on d.root = top.native_object_index""",
    "multi_pivot": f"""select cast(snap as varchar) snapshot_id, {", ".join(f"max(committed) filter (place = {i}) {column_name(c)}_committed, max(resident) filter (place = {i} and available = 1) {column_name(c)}_resident" for i, (_, c) in enumerate(PIVOT))}
        from (select region_index % 4 snap, (region_index // 4) % 11 place, max(address) committed, max(size_bytes) resident, case when (region_index // 4) % 11 in (4, 5) then 0 else 1 end available
        from system_memory_regions where region_index % 4 < 3 or (region_index // 4) % 11 <> 2 group by 1, 2) group by snap""",
    "session_groups": r"""with i as (select 'Game_2026-05-1' || (region_index % 10) || '_10-28-3' || (region_index % 6) || case when region_index % 3 = 0 then '' else '_level_' || region_index % 2 end || case when region_index % 7 = 0 then '#' || region_index else '' end id,
            case when region_index % 4 = 0 then region_index % 8 + 1 else 0 end guid, 'format:' || cast(16 + region_index % 2 as varchar) ver, case when region_index % 5 <> 0 then address end recorded, region_index from system_memory_regions),
        n as (select *, regexp_matches(id, '^.+?_\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}(_.+)?$') named, split_part(id, '_', 2) d, split_part(id, '_', 3) clock, nullif(array_to_string(list_slice(string_split(id, '_'), 4, 99), '_'), '') context from i),
        k as (select *, case when recorded is not null then make_timestamp(recorded * 1000000) when named then strptime(d || ' ' || clock, '%Y-%m-%d %H-%M-%S') end at_,
            lower(case when guid <> 0 then 'guid:' || guid when named then 'Game|' || d || '|' || coalesce(context, clock) || '|' || ver else id || '|_general|' || ver end) session_key from n),
        g as (select session_key, case when count(at_) = count(*) then min(at_) end began, first(id order by at_ nulls first, lower(id), id) representative, first(ver order by at_ nulls first, lower(id), id) ver,
            first(case when named then 'Game' else id end order by at_ nulls first, lower(id), id) product from k group by session_key),
        o as (select *, row_number() over (order by began nulls first, session_key) session_no from g)
        select k.id snapshot_id, cast(o.session_no as integer) session_no, session_key, o.representative, 'Session ' || o.session_no || ' · ' || o.product || ' · Snap format ' || replace(o.ver, 'format:', '') title from k join o using (session_key)""",
}


def oracle_sql() -> dict[str, str]:
    """Each statement behind a WITH clause of the tables that it names."""
    out = {}
    for name, q in SQL.items():
        used = [t for t in STAR if f" {t}" in q.replace("(", " ").replace("\n", " ")]
        # A statement with its own WITH clause goes into a subquery.
        out[name] = star_prefix(*used) + f"select * from ({q})"
    return out
