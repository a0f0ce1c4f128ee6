"""Every registered query against its check SQL, on the smallest data."""

import pytest
from check import compare, connect

from trailhound.plans.catalog import ORACLES, QUERIES

WITHOUT_SQL = set()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, sf_dir, name):
    problem, _ = compare(spark, connection, sf_dir, name, QUERIES[name], ORACLES.get(name))
    assert not problem, problem


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert sum(r["n"] for r in rows) == 1000
    assert set(entry.queries()) >= set(entry.oracle_sql())
