"""Streams with lists, timers and two inputs: late records, restarts, and state that goes."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from veilmeter.operators import finops, mapping
from veilmeter.sources import streams
from veilmeter.streaming import breaker, ingest, restore, state

START = dt.datetime(2024, 3, 1)
CALLS = "provider string, ts timestamp, failed boolean"
KEY = "0f" * 32


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def folder(tmp_path, name):
    return str(tmp_path / f"{name}-{uuid.uuid4().hex[:6]}")


def run(spark, out, path, checkpoint):
    """One run over what is there; the state's rows at its end."""
    with state.rocksdb(spark):
        q = out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
        q.awaitTermination()
    done = [p for p in q.recentProgress if p["stateOperators"]]
    return [o["numRowsTotal"] for o in done[-1]["stateOperators"]] if done else []


def test_breaker_with_late_calls_and_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for _ in range(900):
        s = rng.uniform(0, 2400)
        provider = rng.choice(["p", "q", None])
        rows.append((s + rng.uniform(0, 50), provider, s, rng.random() < (0.8 if int(s / 200) % 3 == 0 else 0.1)))
    source, path, checkpoint = (folder(tmp_path, n) for n in ("in", "out", "cp"))
    calls = [(p, at(s), f) for _, p, s, f in rows]
    parts = [[(p, at(s), f) for arrived, p, s, f in rows if low <= arrived < low + 500] for low in range(0, 2500, 500)]
    # A call that comes an hour late is not counted; the last one moves event time on.
    parts += [[("q", at(9000), False)], [("q", at(5), True)] * 50, [("none", at(10**7), False)], [("none", at(2 * 10**7), False)]]
    for part in parts:
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(source)
        out = breaker.live_breaker(streams.record_files(spark, source, CALLS), late="60 seconds")
        left = run(spark, out, path, checkpoint)
    events = spark.read.schema(breaker.EVENTS).parquet(path).collect()
    want = finops.breaker_intervals(spark.createDataFrame(calls, CALLS).where("provider IS NOT NULL")).collect()
    got = {(r.provider, r.at_s, r.until_s) for r in events if r.event == "opened" and r.provider is not None}
    assert got == {(r.provider, r.opened_s, r.closes_s) for r in want} and len(got) > 6
    assert any(r.provider is None for r in events)
    opened = sorted((str(r.provider), r.until_s) for r in events if r.event == "opened")
    assert opened == sorted((str(r.provider), r.at_s) for r in events if r.event == "closed")
    assert sum(left) <= 6  # only the provider that closes the test


CHUNKS = "call_id string, seq bigint, text string, last boolean, ts timestamp"
PUTS = "call_id string, put_ts timestamp, mapping map<string,string>"


def test_restore_with_mappings_of_another_stream(spark, tmp_path):
    text = "call <PHO", "NE_1> now"
    chunks, puts = [[], [], []], [[], [], []]
    for n, call in enumerate("abcdef"):
        first = 100 * n
        chunks[0 if call != "a" else 1] += [(call, 0, text[0], False, at(first))]
        chunks[1] += [(call, 1, text[1], call != "f", at(first + 1))] if call != "e" else []
    one, two = {"<PHONE_1>": "0900"}, {"<PHONE_1>": "0911"}
    puts[1] += [("a", at(-5), one), ("b", at(100 - 302), one), ("c", at(200 - 9), one), ("c", at(200 - 3), two), ("c", at(230), one)]
    puts[0] += [("d", at(300 - 4), one), ("e", at(400 - 1), one), ("f", at(500), one)]
    chunks[2], puts[2] = [("end", 0, "", True, at(10**7))], [("end", at(10**7), one)]
    chunks.append([("end", 1, "", True, at(2 * 10**7))])
    puts.append([("end", at(2 * 10**7), one)])
    sources = {n: folder(tmp_path, n) for n in ("chunks", "puts")}
    path, checkpoint = folder(tmp_path, "out"), folder(tmp_path, "cp")
    for a, b in zip(chunks, puts, strict=True):
        spark.createDataFrame(a, CHUNKS).coalesce(1).write.mode("append").parquet(sources["chunks"])
        sealed = mapping.put(spark.createDataFrame(b, PUTS), KEY)
        # The blob of d is sealed for another call's key.
        moved = mapping.put(spark.createDataFrame(b, PUTS).withColumn("call_id", F.concat("call_id", F.lit("x"))), KEY)
        moved = moved.withColumn("store_key", F.substring("store_key", 1, 9)).where("store_key = 'pii-map:d'")
        sealed = sealed.where("store_key <> 'pii-map:d'").unionByName(moved).select("store_key", "put_ts", "blob")
        sealed.coalesce(1).write.mode("append").parquet(sources["puts"])
        streamed = [streams.record_files(spark, sources["chunks"], CHUNKS), streams.record_files(spark, sources["puts"], sealed.schema)]
        left = run(spark, restore.restore_joined(*streamed, KEY, late="20 minutes"), path, checkpoint)
    rows = spark.read.schema(restore.CHUNK_OUT).parquet(path).where("call_id <> 'end'").orderBy("seq", "part").collect()
    got = {call: "".join(r.text for r in rows if r.call_id == call) for call in "abcdef"}
    assert got == {
        "a": "call 0900 now", "b": "call <PHONE_1> now", "c": "call 0911 now", "d": "call <PHONE_1> now",
        "e": "call <PHO", "f": "call 0900 now",
    }
    assert max(r.part for r in rows) == 1  # the tail of e was let go by its timer
    assert len(rows) == 12  # every chunk once, though several mappings were put for c
    assert sum(left) <= 8


def test_joined_calls_share_states(spark, tmp_path):
    """Many calls with chunks, repeats of them and mappings at odd times: few states, the rows of a plain replay."""
    rng = random.Random(9)
    chunks, puts, want = [], [], {}
    for n in range(60):
        call, text, size = f"c{n}" if n else None, "số <PHONE_1> và <PHO", rng.randint(1, 9)
        parts = [text[i : i + size] for i in range(0, len(text), size)]
        rows = [(call, i, part, i == len(parts) - 1, at(1000 * n + i)) for i, part in enumerate(parts)]
        chunks += [*rows, *rng.sample(rows, 2)]
        age = rng.choice([0, 200, 299, 400])
        puts += [(call, at(1000 * n - age - 5), {"<PHONE_1>": "old"}), (call, at(1000 * n - age), {"<PHONE_1>": f"09{n}"})]
        # Text held from its first character keeps the mapping that was live then.
        begun = next(i for i, part in enumerate(parts) if "<" in part)
        want[call] = text.replace("<PHONE_1>", f"09{n}") if call and begun + age <= 300 else text
    rng.shuffle(chunks)
    source, path, checkpoint = {n: folder(tmp_path, n) for n in ("chunks", "puts")}, folder(tmp_path, "out"), folder(tmp_path, "cp")
    closing = [("end", 0, "", True, at(10**7))], [("end", at(10**7), {"a": "b"})]
    left = []
    for some, known in ((chunks, puts), closing):
        spark.createDataFrame(some, CHUNKS).write.mode("append").parquet(source["chunks"])
        sealed = mapping.put(spark.createDataFrame(known, PUTS).where("call_id IS NOT NULL"), KEY).select("store_key", "put_ts", "blob")
        sealed.write.mode("append").parquet(source["puts"])
        streamed = [streams.record_files(spark, source["chunks"], CHUNKS), streams.record_files(spark, source["puts"], sealed.schema)]
        left.append(run(spark, restore.restore_joined(*streamed, KEY, late="40 days", buckets=4), path, checkpoint))
    rows = spark.read.schema(restore.CHUNK_OUT).parquet(path).orderBy("seq", "part").collect()
    got = {call: "".join(r.text for r in rows if r.call_id == call) for call in want}
    assert got == want and len(rows) == len(set(chunks))
    assert sum(left[0]) <= 4 and sum(left[1]) <= 1


def opened_folders(rows, path):
    return [f.rsplit("=", 1)[1] for f in ingest.touched_receipts(rows, path)]


def facts(spark, ids, day=1):
    row = [(i, at(86400 * day), "t", 1) for i in ids]
    made = spark.createDataFrame(row, "stream_id string, ts timestamp, tenant_id string, tokens_in bigint")
    have = {f.name for f in made.schema}
    rest = [c.split()[0] for c in ingest.USAGE_SCHEMA.split(", ") if c.split()[0] not in have | {"month", "day"}]
    kinds = dict(c.split() for c in ingest.USAGE_SCHEMA.split(", "))
    return made.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in rest])


def test_receipts_open_only_the_buckets_of_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "BLOCK_IDS", 100)
    path = folder(tmp_path, "facts")
    ingest.create_table(spark, path, ingest.USAGE_SCHEMA)
    for n in range(6):  # ids as a topic gives them: three partitions, growing offsets
        rows = facts(spark, [f"{p}-{o}" for p in (0, 1, 11) for o in range(100 * n, 100 * n + 100)], n)
        if n:
            assert opened_folders(rows, path) == []
        ingest.append_once(rows, path, ingest.USAGE_SCHEMA, f"run-{n}")
    stored = ingest.read_table(spark, path, ingest.USAGE_SCHEMA)
    assert stored.count() == stored.select("stream_id").distinct().count() == 1800
    again = facts(spark, ["0-0"], 9)  # the very first record, redelivered with another time
    assert opened_folders(again, path) == ["n0-0"]
    ingest.append_once(again, path, ingest.USAGE_SCHEMA, "run-7")
    mixed = facts(spark, ["1-99", "1-100", "11-700", "x", "x-1", "7"], 9)
    assert opened_folders(mixed, path) == ["n1-0", "n1-1"]
    ingest.append_once(mixed, path, ingest.USAGE_SCHEMA, "run-8")
    stored = ingest.read_table(spark, path, ingest.USAGE_SCHEMA)
    assert stored.count() == stored.select("stream_id").distinct().count() == 1804


@pytest.mark.parametrize("died_after", ["rows", "receipts"])
def test_a_batch_that_died_is_stored_once(spark, tmp_path, monkeypatch, died_after):
    """Nothing of a broken batch is seen; its replay or a new job stores it once."""
    path = folder(tmp_path, "facts")
    ingest.create_table(spark, path, ingest.USAGE_SCHEMA)
    rows = facts(spark, ["0-1", "0-2", "odd"])
    done = []
    real = type(rows.write).parquet

    def dying(self, at, *args, **kwargs):
        if done and (at.endswith("/commits") or (died_after == "rows" and at.endswith("/receipts"))):
            raise OSError("executor lost")
        return real(self, at, *args, **kwargs)

    monkeypatch.setattr(type(rows.write), "parquet", dying)
    done.append(1)
    with pytest.raises(OSError):
        ingest.append_once(rows, path, ingest.USAGE_SCHEMA, "a-5")
    done.clear()
    read = lambda: sorted(r.stream_id for r in ingest.read_table(spark, path, ingest.USAGE_SCHEMA).collect())
    assert read() == []
    ingest.append_once(facts(spark, ["0-1", "0-2", "odd", "0-3"], 2), path, ingest.USAGE_SCHEMA, "b-0")
    assert read() == ["0-1", "0-2", "0-3", "odd"]
    ingest.append_once(rows, path, ingest.USAGE_SCHEMA, "a-5")  # the old job comes back
    assert read() == ["0-1", "0-2", "0-3", "odd"]
