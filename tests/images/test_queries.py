"""Every query over images against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from photonlake.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_what_its_sql_gives(spark, tables, name):
    got = QUERIES[name](spark, SF)
    result = tables.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(result.fetchall(), key=key)
