"""Every query with SQL gives DuckDB's rows over the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from heaplens.plans import oracle, registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: ("nan" if math.isnan(x) else round(x, 9)) if isinstance(x, float) else x
    return [names[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(oracle.oracle_sql()[name])
    want = rows([d[0] for d in res.description], res.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) and got[1] == want[1]


def test_queries_without_sql_run(spark):
    for name in sorted(set(registry.QUERIES) - set(oracle.SQL)):
        assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
