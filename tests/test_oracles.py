"""Every registered query on the smallest tables, against its SQL where it has one."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import rows

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = rows(QUERIES[name](spark, SF_DIR).toPandas()), rows(duck.execute(ORACLES[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    assert contract.entry(spark).count() > 0
