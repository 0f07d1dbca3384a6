"""Every query of the stream engine against its SQL."""

import pytest
from tideframe.plans import oracles
from tideframe.plans.queries import QUERIES

from .compare import connect, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    names, rows = spark_rows(QUERIES[name](spark, sf_dir))
    sql_names, expected = sql_rows(con, oracles.ORACLES[name])
    assert names == sql_names
    assert rows == expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracles.ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
