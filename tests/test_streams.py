"""Streams: replays add nothing, batches continue where the last one stopped, cuts do not matter."""

import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilmeter.plans import metering, streams as queries
from veilmeter.sources import streams, tables
from veilmeter.streaming import ingest, quota, restore


def folder(tmp_path, name):
    return str(tmp_path / f"{name}-{uuid.uuid4().hex[:6]}")


def test_a_batch_that_failed_after_its_write_adds_nothing(spark, sf_dir, tmp_path):
    records = tables.usage_raw(spark, sf_dir)
    facts, letters = folder(tmp_path, "facts"), folder(tmp_path, "letters")
    ingest.create_table(spark, facts, ingest.USAGE_SCHEMA)
    store = ingest.usage_batch(facts, letters)
    store(records, 0)
    once = ingest.read_table(spark, facts, ingest.USAGE_SCHEMA).count()
    refused = spark.read.parquet(letters).count()
    store(records, 0)
    again = ingest.read_table(spark, facts, ingest.USAGE_SCHEMA)
    assert (again.count(), again.select("stream_id").distinct().count()) == (once, once)
    assert spark.read.parquet(letters).count() == refused


def test_a_new_checkpoint_replaces_nothing_and_stores_nothing_twice(spark, sf_dir, tmp_path):
    records = tables.usage_raw(spark, sf_dir)
    facts, letters = folder(tmp_path, "facts"), folder(tmp_path, "letters")
    counts = []
    for late in (0, 40):
        # The second run redelivers everything with another end time, and other refused records.
        later = F.col("fields")
        if late:
            shifted = F.transform_values(
                later, lambda k, v: F.when(k == "end_time", (v.cast("double") + 86400 * late).cast("string")).otherwise(v)
            )
            later = F.map_concat(F.map_filter(shifted, lambda k, v: k != "team_id"), F.create_map(F.lit("team_id"), F.lit("x")))
            later = F.when(F.pmod(F.col("stream_id").cast("int"), F.lit(7)) == 0, later).otherwise(shifted)
        source = folder(tmp_path, "in")
        records.withColumn("fields", later).write.parquet(source)
        ingest.ingest_usage(
            streams.record_files(spark, source), facts, letters, folder(tmp_path, "cp"), once=True
        ).awaitTermination()
        stored = ingest.read_table(spark, facts, ingest.USAGE_SCHEMA)
        counts.append((stored.count(), stored.select("stream_id").distinct().count(), spark.read.parquet(letters).count()))
    assert counts[0][:2] == counts[1][:2] and counts[0][0] == counts[0][1]
    assert counts[1][2] > 2 * counts[0][2]
    assert spark.read.parquet(letters).select("run").distinct().count() == 2


def test_new_files_continue_the_stream(spark, sf_dir, tmp_path):
    records = tables.usage_raw(spark, sf_dir)
    source, facts = folder(tmp_path, "in"), folder(tmp_path, "facts")
    letters, checkpoint = folder(tmp_path, "letters"), folder(tmp_path, "cp")
    half = F.pmod(F.col("stream_id").cast("int"), F.lit(2)) == 0
    for part in (records.filter(half), records):
        part.write.mode("append").parquet(source)
        ingest.ingest_usage(streams.record_files(spark, source), facts, letters, checkpoint, once=True).awaitTermination()
    stored = ingest.read_table(spark, facts, ingest.USAGE_SCHEMA).select("stream_id")
    want = metering.facts(spark, sf_dir).select("stream_id")
    assert stored.exceptAll(want).count() == 0 and want.exceptAll(stored).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 50])
def test_chunk_size_does_not_change_the_answer(spark, size):
    text = "Máy lẻ <PHONE_1> trực đêm; x < y, <z <PHONE_9> <ORDER_2>"
    parts = [text[i:i + size] for i in range(0, len(text), size)]
    known = {"<PHONE_1>": "0356 700 811", "<ORDER_2>": "#A12<3"}
    rows = [("c", i, p, i == len(parts) - 1, known) for i, p in reversed(list(enumerate(parts)))]
    df = spark.createDataFrame(rows, "call_id string, seq bigint, text string, last boolean, mapping map<string,string>")
    out = queries.through(df, "sizes", lambda c: restore.restore_chunks(c, None)).orderBy("seq", "part").collect()
    assert "".join(r.text for r in out) == text.replace("<PHONE_1>", "0356 700 811").replace("<ORDER_2>", "#A12<3")
    assert all("PHONE_1" not in r.text for r in out)


def test_live_quota_continues_over_batches(spark, sf_dir, tmp_path):
    requests = metering.quota_requests(spark, sf_dir)
    source, out, checkpoint = folder(tmp_path, "in"), folder(tmp_path, "out"), folder(tmp_path, "cp")
    middle = requests.approxQuantile("ts", [0.5], 0)[0]
    for part in (requests.filter(F.col("ts") <= middle), requests.filter(F.col("ts") > middle)):
        part.write.mode("append").parquet(source)
        live = quota.admit(streams.record_files(spark, source, requests.schema), None)
        live.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    from veilmeter.operators.quota import replay

    want = replay(requests).select("request_id", "admitted", "reason")
    got = spark.read.parquet(out).select("request_id", "admitted", "reason")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_held_text_is_sent_after_its_wait():
    """A timeout sends the tail restored, behind the chunk it ended, and drops the state."""
    from types import SimpleNamespace

    class State(SimpleNamespace):
        def update(self, value):
            self.get, self.exists = value, True

        def remove(self):
            self.exists = False

        def setTimeoutDuration(self, ms):
            self.wait = ms

    state = State(exists=False, hasTimedOut=False, get=None)
    handle = restore._stateful(restore._chunk, 1000)
    rows = pd.DataFrame({"seq": [4], "text": ["call <PHONE_1> or <PHO"], "last": [False], "mapping": [{"<PHONE_1>": "09"}]})
    first = list(handle(("c",), iter([rows]), state))[0]
    assert first.values.tolist() == [["c", 4, 0, "call 09 or "]] and state.wait == 1000
    state.hasTimedOut = True
    assert list(handle(("c",), iter([]), state))[0].values.tolist() == [["c", 4, 1, "<PHO"]]
    assert not state.exists


class Shared:
    """A state that calls share, at a given time."""

    def __init__(self):
        self.exists, self.hasTimedOut, self.now = False, False, 5000

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.exists = False

    def setTimeoutDuration(self, ms):
        self.wait = ms

    def getCurrentProcessingTimeMs(self):
        return self.now


def _chunk_rows(*rows):
    return iter([pd.DataFrame(rows, columns=["call_id", "seq", "text", "last", "mapping"])])


def test_calls_of_a_state_wait_each_for_themselves():
    """Two calls wait in one state; each is let go when its own time is over, with its own mapping."""
    state, handle = Shared(), restore._shared(restore._chunk, 1000)
    known = '{"<A_1>": "x"}', '{"<A_1>": "y"}'
    out = next(handle((0,), _chunk_rows(("c", 1, "<A", False, known[0]), ("c", 0, "p<A_1>", False, known[0])), state))
    assert out.values.tolist() == [["c", 0, 0, "px"], ["c", 1, 0, ""]] and state.wait == 1000
    state.now = 5600
    out = next(handle((0,), _chunk_rows((None, 0, "q<A_1", False, known[1])), state))
    assert out.values.tolist() == [[None, 0, 0, "q"]] and state.wait == 400
    state.now, state.hasTimedOut = 6000, True
    assert next(handle((0,), iter([]), state)).values.tolist() == [["c", 1, 1, "<A"]] and state.wait == 600
    state.now, state.hasTimedOut = 6100, False
    out = next(handle((0,), _chunk_rows((None, 1, ">", False, None)), state))
    assert out.values.tolist() == [[None, 1, 0, "y"]] and not state.exists


def test_frames_of_many_calls_share_states(spark, sf_dir):
    """The rows of a state for each call, from four states."""
    frames = queries.event_frames(spark, sf_dir)
    shared, alone = (queries.through(frames, "frames", lambda f, n=n: restore.restore_frames(f, None, n)) for n in (4, None))
    assert shared.exceptAll(alone).count() == 0 and alone.exceptAll(shared).count() == 0


def test_quota_counts_outlive_a_backlog(spark, tmp_path):
    """A minute's counts stay until event time has passed, whatever the wall clock, and then go."""
    source, out, checkpoint = folder(tmp_path, "in"), folder(tmp_path, "out"), folder(tmp_path, "cp")
    schema = ("request_id bigint, tenant string, bucket bigint, ts bigint, tokens bigint, rpm bigint, tpm bigint, "
              "event_time timestamp")
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    for part in ([(1, 0), (2, 5)], [(3, 30)], [(4, 100_000)], [(5, 100_010)], [(6, 20)]):
        rows = [(i, "t", s // 60, s, 1, 10, 100, at(s)) for i, s in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        live = quota.admit(streams.record_files(spark, source, schema))
        live.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    counts = {r.request_id: r.rpm_count for r in spark.read.parquet(out).collect()}
    assert counts == {1: 1, 2: 2, 3: 3, 4: 1, 5: 2}  # the last one is a day late
