"""Every registered query at the smallest scale, against its checking SQL where it has one."""

import os

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(queries()))
def test_query(spark, duck, key):
    df = queries()[key](spark, SF)
    rows = df.collect()
    if key not in oracle_sql():
        assert rows
        return
    cur = duck.execute(oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert check.rows_of(df.columns, rows) == check.rows_of(names, cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0
