"""Every registered query against its SQL on the small data set."""

import pytest

import __spark_entry__ as entry_point
from check import compare, oracle_connection
from papertrail.plans import catalog

QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(SQL) & set(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, sf_dir, name):
    verdict = compare(spark, con, sf_dir, QUERIES[name], SQL[name])
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0 and "is_valid" in df.columns
