"""The driver's contract: queries and SQL have the same names, columns and values."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from seqloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["cluster_id", "rep_id", "member_id"] and out.count() == 200


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql_agrees(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert key(got) == key(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_run(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
