"""Every query with SQL against DuckDB, on the driver's smallest tables."""

import math
import os

import duckdb
import pytest

from gridspark import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 9) + 0.0 if isinstance(v, float) else v


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", [n for n, q in catalog.QUERIES.items() if q.sql])
def test_query(spark, duck, name):
    q = catalog.QUERIES[name]
    df, want = q.run(spark, SF), duck.sql(q.sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", [n for n, q in catalog.QUERIES.items() if not q.sql])
def test_rows(spark, name):
    assert catalog.QUERIES[name].run(spark, SF).count() > 0
