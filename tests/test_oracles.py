"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, database
from veilmeter import plans

QUERIES, SQL = plans.QUERIES, plans.SQL
#: Queries that find nothing in the smallest tables.
EMPTY = {"f06_slo_streaks"}
#: What SQL cannot express: the recall of an approximate index. ``test_vector_index.py`` checks it.
WITHOUT_SQL = {"rd_index_recall"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) - WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, sf_dir, name):
    problem, _, _ = compare(spark, con, name, QUERIES[name], SQL[name], sf_dir)
    assert problem is None or (problem == "no rows" and name in EMPTY), problem


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
