"""The SQL users' table function: only the session's tenant and groups, nothing by default."""

import pytest

from veilmeter.sources import isolation

CHUNKS = "tenant_id string, id bigint, acl_groups array<string>, quarantined boolean"
ROWS = [("t1", 1, ["a"], False), ("t1", 2, ["b"], False), ("t1", 3, ["a", "b"], True), ("t2", 4, ["a"], False), (None, 5, ["a"], False), ("t1", 6, None, False), ("t'1", 7, ["a"], None)]


@pytest.fixture
def session(spark, tmp_path):
    mine = spark.newSession()
    path = str(tmp_path / "chunks")
    mine.createDataFrame(ROWS, CHUNKS).write.parquet(path)
    isolation.install(mine, path)
    return mine


def seen(session, where=""):
    return sorted(r.id for r in session.sql(f"SELECT id FROM visible_chunks() {where}").collect())


def test_nothing_without_a_tenant(session):
    assert seen(session) == []
    isolation.act_as(session, None, ["a"])
    assert seen(session) == []
    isolation.act_as(session, "t1")
    assert seen(session) == []


def test_own_rows_only(session):
    isolation.act_as(session, "t1", ["a"])
    assert seen(session) == [1]
    isolation.act_as(session, "t1", ["a", "b", "it's"])
    assert seen(session) == [1, 2]
    # A condition of the user's cannot widen what the function returns.
    assert seen(session, "WHERE tenant_id = 't2' OR true") == [1, 2]
    isolation.act_as(session, "t'1", ["a"])
    assert seen(session) == []
    isolation.act_as(session, "t2", ["a"])
    assert seen(session) == [4]


def test_the_tenant_reaches_the_scan(session):
    isolation.act_as(session, "t1", ["a"])
    plan = session.sql("SELECT id FROM visible_chunks()")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tenant_id,t1)" in plan.split("PushedFilters")[1]


def test_sessions_do_not_share(spark, session, tmp_path):
    isolation.act_as(session, "t1", ["a"])
    other = spark.newSession()
    isolation.install(other, str(tmp_path / "chunks"))
    assert seen(other) == [] and seen(session) == [1]
