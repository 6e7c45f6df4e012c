"""Stored tables: only the files with rows to erase change, a broken run goes on, holds survive."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from veilmeter.operators import erasure as S

SCHEMA = "location string, ref string, day string, n bigint"
WANTED = "store string, location string, held boolean"


def table(spark, tmp_path, blank=()):
    path = str(tmp_path / uuid.uuid4().hex)
    rows = [(f"l{i}", f"r{i}", f"2024 01:{i % 4}", i) for i in range(400)] + [("l7", "again", "2024 01:3", 7), (None, "none", "x", 0)]
    # Two files a day: even and odd hundreds.
    df = spark.createDataFrame(rows, SCHEMA).withColumn("half", F.floor(F.col("n") / 100) % 2)
    for h in (0, 1):
        df.where(F.col("half") == h).drop("half").repartition(1).write.mode("append").partitionBy("day").parquet(path)
    return S.Store("s", path, SCHEMA, "location", ("day",), blank)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def read(spark, store):
    return sorted(map(tuple, store.read(spark).collect()), key=repr)


def wanted(spark):
    rows = [("s", "l7", False), ("s", "l11", False), ("s", "l12", True), ("s", "nowhere", False), ("other", "l20", False)]
    return spark.createDataFrame(rows, WANTED)


@pytest.mark.parametrize("blank", [(), ("ref",)])
def test_only_files_with_such_rows_change(spark, tmp_path, blank):
    store, folder = table(spark, tmp_path, blank), str(tmp_path / "run 1")
    before, names = read(spark, store), files(store.path)
    r = S.erase_stored(spark, [store], wanted(spark), folder).first()
    assert (r.found, r.held, r.erased, r.remaining, r.passes, r.status) == (4, 1, 3, 0, 1, "completed")
    gone = {"l7", "l11"}
    want = [x[:1] + (None,) + x[2:] if x[0] in gone else x for x in before] if blank else [x for x in before if x[0] not in gone]
    assert read(spark, store) == sorted(want, key=repr) and r.rows == len(want)
    kept = names & files(store.path)
    assert len(names - kept) == 1 and len(kept) == len(names) - 1  # l7 and l11 lie in one file
    # The same run again, and a new one, change nothing.
    now = files(store.path)
    assert S.erase_stored(spark, [store], wanted(spark), folder).first() == r
    assert S.erase_stored(spark, [store], wanted(spark), str(tmp_path / "run2")).first().erased == 0
    assert files(store.path) == now


@pytest.mark.parametrize("moves", [0, 1])
def test_a_broken_run_goes_on(spark, tmp_path, monkeypatch, moves):
    store, folder = table(spark, tmp_path), str(tmp_path / "run")
    before = read(spark, store)
    done = []

    def move(self, source, to):
        if len(done) == moves:
            raise OSError("driver lost")
        done.append(to)
        return real(self, source, to)

    real = S._Files.move
    many = spark.createDataFrame([("s", f"l{i}", False) for i in (0, 1, 2, 3, 150)], WANTED)
    monkeypatch.setattr(S._Files, "move", move)
    with pytest.raises(OSError):
        S.erase_stored(spark, [store], many, folder)
    monkeypatch.setattr(S._Files, "move", real)
    r = S.erase_stored(spark, [store], many, folder).first()
    assert (r.found, r.erased, r.remaining, r.status) == (5, 5, 0, "completed")
    assert read(spark, store) == [x for x in before if x[0] not in {"l0", "l1", "l2", "l3", "l150"}]


def test_rows_that_keep_coming_are_escalated(spark, tmp_path, monkeypatch):
    store, folder = table(spark, tmp_path), str(tmp_path / "run")
    real = S._swap

    def swap(*args):
        real(*args)
        spark.createDataFrame([("l7", "back", "2024 01:3", 7)], SCHEMA).write.mode("append").partitionBy("day").parquet(store.path)

    monkeypatch.setattr(S, "_swap", swap)
    r = S.erase_stored(spark, [store], wanted(spark), folder).first()
    assert (r.passes, r.remaining, r.status) == (3, 1, "escalated")


def test_sweep_and_empty(spark, tmp_path):
    store = table(spark, tmp_path)
    everything = store.read(spark).select("location")
    r = S.sweep_stored(spark, store, everything, str(tmp_path / "sweep")).first()
    assert (r.erased, r.rows, r.status) == (401, 1, "completed") and read(spark, store) == [(None, "none", 0, "x")]
    none = spark.createDataFrame([], WANTED)
    assert S.erase_stored(spark, [store], none, str(tmp_path / "none")).first().found == 0
