import pytest
from edge import clashing, documents

from veilmeter.llm.sharding import SHARDS, lookup, next_prime, shard, slots_for, write_shards


def claims(shards, slots):
    """Turn by turn, with whole preference lists."""
    import hashlib

    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    orders = [
        [(number(s + "/offset") + j * (number(s + "/step") % (slots - 1) + 1)) % slots for j in range(slots)]
        for s in shards
    ]
    owner, turn = {}, 0
    while len(owner) < slots:
        i = turn % len(shards)
        owner[next(x for x in orders[i] if x not in owner)] = i
        turn += 1
    return [owner[x] for x in range(slots)]


@pytest.mark.parametrize("n,slots", [(1, 2), (1, 7), (3, 7), (5, 101), (16, 1607), (7, 7)])
def test_table(n, slots):
    names = [f"s{i}" for i in range(n)]
    table = lookup(names, slots)
    assert table == claims(names, slots)
    held = [table.count(i) for i in range(n)]
    assert max(held) - min(held) <= 1


def test_removal_moves_little():
    slots = 10_007
    before, after = lookup(SHARDS, slots), lookup(SHARDS[:-1], slots)
    stayed = sum(a == b for a, b in zip(before, after, strict=True) if b < len(SHARDS) - 1 and a < len(SHARDS) - 1)
    kept = sum(a < len(SHARDS) - 1 for a in before)
    assert stayed / kept > 0.8


@pytest.mark.parametrize("shards,slots", [((), 7), (("a", "a"), 7), (("a",), 8), (("a", "b", "c"), 2)])
def test_wrong_parameters(shards, slots):
    with pytest.raises(ValueError):
        lookup(shards, slots)


def test_edge_rows(spark):
    docs = clashing(documents(spark))
    got = shard(docs)
    assert set(got.columns) == set(docs.columns) and got.count() == 12
    rows = got.collect()
    assert all(r["shard"] in SHARDS and 0 <= r["slot"] < slots_for(SHARDS) for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 4}) == 1
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert shard(documents(spark, [])).count() == 0


def test_even_and_written(spark, tmp_path):
    docs = spark.range(40_000).withColumnRenamed("id", "doc_id")
    counts = [r["count"] for r in shard(docs).groupBy("shard").count().collect()]
    assert len(counts) == len(SHARDS) and max(counts) < 1.1 * min(counts)
    write_shards(docs, str(tmp_path / "out"), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40_000 and back.select("shard").distinct().count() == len(SHARDS)


def test_next_prime():
    assert [next_prime(x) for x in (0, 2, 4, 8, 1601, 1602)] == [2, 2, 5, 11, 1601, 1607]
