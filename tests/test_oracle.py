"""Every query with an SQL twin agrees with it on the smallest tables."""

import pytest

from __spark_entry__ import entry
from changegrid.catalog import QUERIES
from changegrid.oracle import SQL
from tools.check_oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    sql = SQL.get(name)
    if sql is None:
        assert got.count() > 0
    else:
        assert compare(got.toPandas(), con.execute(sql).fetchdf()) == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows_and_a_stable_schema(spark):
    a, b = entry(spark), entry(spark)
    assert a.schema == b.schema and a.count() > 0
