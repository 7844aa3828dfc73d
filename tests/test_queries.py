"""Every registered query against its oracle on the smallest tables."""

import os

import duckdb
import pytest

from strandline.queries.registry import ORACLES, QUERIES, entry

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "orders", "lineitem", "events", "nation"]
#: Queries whose answer is that there is nothing.
EMPTY = {"get_missing", "range_inverted", "prefix_none"}


@pytest.fixture(scope="module")
def oracle():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.select(sorted(df.columns)).collect()]
    assert bool(got) == (name not in EMPTY)
    want = oracle.sql(ORACLES[name])
    order = sorted(want.columns)
    assert sorted(df.columns) == order
    key = lambda row: tuple(str(x) for x in row)
    assert sorted(got, key=key) == sorted(want.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall(), key=key)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).count() == 1
