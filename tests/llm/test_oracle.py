"""The problems' queries with SQL, against DuckDB, and all of them as they are registered."""

import glob
import os

import duckdb
import pytest

from marginalia.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    got = queries.QUERIES[name](spark, data)
    rows = sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=repr)
    if name in queries.SQL:
        con = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        want = con.sql(queries.SQL[name])
        order = sorted(want.columns)
        assert rows == sorted(con.sql(f"select {', '.join(order)} from ({queries.SQL[name]})").fetchall(), key=repr)
