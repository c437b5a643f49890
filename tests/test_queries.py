"""Every catalogue query gives the rows of its SQL, on the smallest sample tables."""

import os

import pytest

from palimpsest.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}/*.parquet" if os.path.isdir(f"{SF}/{name}") else f"{SF}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sql, name):
    got = queries.QUERIES[name](spark, SF)
    want = sql.execute(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
