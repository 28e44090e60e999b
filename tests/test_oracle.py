"""Every registered query of the core with SQL, against DuckDB on the small test tables."""

import glob
import os

import duckdb
import pytest

from marginalia.plans import catalogue


def rounded(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or x != x else round(float(x), 5) if isinstance(x, float) else int(x) if hasattr(x, "dtype") and x.dtype.kind in "iu" else x
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, duck, name):
    got = catalogue.QUERIES[name](spark, data).toPandas()
    if name in catalogue.SQL:
        want = duck.sql(catalogue.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rounded(got) == rounded(want)
