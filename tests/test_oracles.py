"""Every registered query against its SQL twin at the smallest scale."""

import pytest
from oracle_tools import connect, differences

import __spark_entry__ as registered

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert differences(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert registered.entry(spark).count() > 0
