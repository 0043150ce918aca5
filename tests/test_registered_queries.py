"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLES)


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query(spark, con, sf_dir, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf_dir) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_type", "n", "mean_k", "top_k"] and df.count() > 0
