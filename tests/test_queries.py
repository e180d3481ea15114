"""Every registered query against its SQL on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(spark, duck, name):
    frame = contract.queries()[name](spark, SF_DIR)
    cursor = duck.execute(contract.oracle_sql()[name])
    verdict = compare(frame.columns, [tuple(r) for r in frame.collect()], [d[0] for d in cursor.description], cursor.fetchall())
    assert verdict == "ok"


def test_every_oracle_has_a_query():
    assert contract.oracle_sql().keys() <= contract.queries().keys()


def test_entry_runs(spark):
    assert contract.entry(spark).count() == 5
