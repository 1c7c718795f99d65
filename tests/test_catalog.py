"""Every catalog query against its SQL counterpart, on the smallest tables."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from palaver.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert differences(spark, duck, name, queries()[name], SQL[name], SF_DIR) is None


def test_entry(spark):
    assert entry(spark).columns[:2] == ["author", "messages"]
    assert entry(spark).count() > 0
