"""Every registered query against its SQL on the smallest tables; those without SQL must run."""

import math

import duckdb
import pytest

from tessera.plans import catalog, further, more, trading

SF = "/root/testdata/sf0.001"
PARTS = catalog, more, trading, further
QUERIES = {name: run for part in PARTS for name, run in part.queries().items()}
SQL = {name: sql for part in PARTS for name, sql in part.oracle_sql().items()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "supplier", "events", "orders"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cell(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(map(cell, r)) for r in df.collect()]
    if name not in SQL:
        assert got
        return
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    order = [names.index(c) for c in df.columns]
    assert sorted(names) == sorted(df.columns)
    rows = [tuple(cell(r[i]) for i in order) for r in want.fetchall()]
    assert sorted(got, key=str) == sorted(rows, key=str)
