"""Every registered query of the core against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from weft.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}" if os.path.isfile(f"{SF}/{name}") else f"{SF}/{name}/*.parquet"
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got or name == "since_drop_orphans"  # all its rows are before the bound in this table
    if name in SQL:
        want = tables.sql(SQL[name])
        assert sorted(want.columns) == columns
        assert got == sorted(want.select(", ".join(columns)).fetchall(), key=repr)
