"""Snapshot tables as DataFrames: from a stored snapshot, or derived from the star schema of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heaplens.schema import TABLES, schema

#: Snapshot tables derived from star-schema tables, in SQL that Spark and DuckDB run alike.
STAR = {
    "native_objects": """select cast(p_partkey as int) native_object_index, cast(p_partkey * 7 as string) instance_id, p_name name,
        case when p_partkey % 97 = 0 then cast(0 as bigint) else cast(floor(p_retailprice) as bigint) * cast(p_size as bigint) * p_size * p_size end size_bytes,
        p_partkey * 65536 native_object_address, p_partkey % 500 root_reference_id, p_size type_index,
        case when p_size <= 5 then 'AssetBundle' when p_size <= 9 then 'MonoScript' when p_partkey % 53 = 0 then cast(null as string) else p_type end native_type_name,
        (p_partkey % 11 = 0) is_destroyed,
        case when p_partkey % 5 = 0 then cast(null as bigint) else cast(floor(p_retailprice) as bigint) * p_size end resident_size_bytes from {part}""",
    "managed_objects": """select cast(o_orderkey as int) managed_object_index, o_orderkey * 128 address, cast(floor(o_totalprice) as bigint) size_bytes,
        cast(o_custkey % 40 as int) type_index, concat('T', cast(o_custkey % 40 as string)) managed_type_name,
        case when o_orderkey % 3 = 0 then cast(null as bigint) when o_custkey % 40 < 5 then cast(null as bigint) else o_orderkey % 2000 end native_object_index from {orders}""",
    "connections": """select distinct case when l_linenumber % 4 = 3 then 'managed_object' else 'native_object' end from_kind, l_partkey from_index,
        case when l_linenumber % 5 = 4 then 'managed_object' else 'native_object' end to_kind, l_orderkey % 2000 to_index,
        case when l_linenumber % 4 = 3 then 'managed_reference' when l_linenumber % 5 = 4 then 'native_gc_handle_bridge' else 'native_connection' end connection_type from {lineitem}""",
    "native_roots": """select cast(s_suppkey as int) root_index, s_suppkey root_id,
        case when s_suppkey % 5 = 0 then 'SerializedFile' when s_suppkey % 7 = 0 then 'PersistentManager' when s_suppkey % 11 = 0 then 'PersistentManager.Remapper' else n_name end area_name,
        case when s_suppkey % 7 = 0 then 'Remapper' else s_name end object_name, cast(floor(abs(s_acctbal) * 100) as bigint) accumulated_size_bytes,
        cast(floor(abs(s_acctbal) * 50) as bigint) resident_size_bytes from {supplier} join {nation} on s_nationkey = n_nationkey""",
    "memory_regions": """select n_nationkey region_index, cast(n_nationkey as bigint) * 1000000 address_base,
        case when n_nationkey % 6 = 0 then cast(0 as bigint) else cast(500000000 as bigint) end address_size, n_name name,
        case when n_nationkey = n_regionkey then cast(null as int) else n_regionkey end parent_region_index,
        case when n_nationkey % 4 = 0 then cast(null as int) else n_nationkey + 1 end first_allocation_index, n_nationkey * 10 num_allocations from {nation}""",
    "native_allocations": """select cast(l_orderkey * 64 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) as int) allocation_index,
        l_orderkey * 1000 + l_linenumber * 100 address, cast(floor(l_extendedprice) as bigint) size_bytes, cast(floor(l_tax * 100) as bigint) overhead_size_bytes,
        cast(floor(l_discount * 100) as bigint) padding_size_bytes, cast(l_suppkey % 25 as int) memory_region_index,
        case when l_quantity < 10 then cast(null as bigint) else l_partkey % 500 end root_reference_id from {lineitem}""",
    "system_memory_regions": """select cast(c_custkey as int) region_index, c_custkey * 10000 address, cast(6000 + (c_custkey % 4) * 2000 as bigint) size_bytes,
        cast(3000 as bigint) resident_bytes, cast(c_custkey % 3 as int) type, c_mktsegment name from {customer}""",
}
STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


class Snapshot:
    """The tables of a snapshot, as attributes; missing ones are empty."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.__dict__.get("tables", {}):
            return self.tables[name]
        if name in TABLES:
            return self.spark.createDataFrame([], schema(name))
        raise AttributeError(name)

    def has_column(self, table: str, column: str) -> bool:
        return table in self.tables and column in self.tables[table].columns

    def register(self) -> None:
        """Temp views of all tables, for ad-hoc SQL."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)


def from_star(spark: SparkSession, sf_dir: str) -> Snapshot:
    base = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in STAR_TABLES}
    return Snapshot(spark, {name: spark.sql(q, **{t: df for t, df in base.items() if f"{{{t}}}" in q}) for name, q in STAR.items()})


def star_prefix(*tables: str) -> str:
    """The same derivation as a WITH clause for other engines."""
    return "with " + ", ".join(f"{t} as ({STAR[t].format(**{x: x for x in STAR_TABLES})})" for t in tables) + " "
