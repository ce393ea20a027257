import math
from pathlib import Path

import duckdb
import pytest

from heaplens.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    res = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in res.description]
    cell = lambda x: ("nan" if math.isnan(x) else round(x, 9)) if isinstance(x, float) else x
    want = sorted((tuple(map(cell, r)) for r in res.fetchall()), key=repr)
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(map(cell, r)) for r in df.select(*names).collect()), key=repr) == want
