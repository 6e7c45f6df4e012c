"""Every operator's query: against its SQL where it has one, and registered for all thirteen."""

import pytest

import __spark_entry__ as entry
from compare import compare, database
from veilmeter.llm.queries import QUERIES, SQL


def test_all_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) < set(names) and "pipeline" in names
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    problem, rows, _ = compare(spark, database(sf_dir), name, QUERIES[name], SQL[name], sf_dir)
    assert problem is None and rows > 0
