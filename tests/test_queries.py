"""Every registered query against its SQL in another engine, at the smallest scale."""

import pytest

import __spark_entry__ as entry_points
from check_oracles import connect, difference
from tallow.oracles import ORACLES
from tallow.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_each_own_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    ours = entry_points.queries()[name](spark, SF_DIR).toPandas()
    theirs = duck.sql(entry_points.oracle_sql()[name]).df()
    assert difference(ours, theirs) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() == 947
