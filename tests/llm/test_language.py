import zlib

import numpy as np
import pytest
from edge import clashing, documents

from veilmeter.llm.language import FEATURES, centroids, counts, languages, vectors

SCHEMA = "doc_id long, text string, lang string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = languages(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) >= 0.98 * len(tested)
    assert all(0 <= r.score <= 1 for r in rows)


def test_counts_are_the_same_in_pieces(monkeypatch):
    from veilmeter.llm import language

    text = "Straße, 12 Äpfel; ÎLE à vélo — 漢字 🙂 x" * 9
    whole = counts(text)
    for n in (1, 2, 7, 50):
        monkeypatch.setattr(language, "_PIECE", n)
        assert (language.counts(text) == whole).all()
    assert counts(None) is None and counts("") is None and counts("12 -- 🙂") is None
    a = counts("a")
    assert a.sum() == 2 + 2 + 1 - 0  # a, blank after it; two pairs; one triple


def test_centroids_split_clusters():
    rng = np.random.default_rng(0)
    rows = [np.bincount(rng.integers(k * 100, k * 100 + 50, 400), minlength=FEATURES) for k in (0, 1, 2) for _ in range(20)]
    c, least = centroids(vectors(rows, np.ones(FEATURES, np.float32)))
    x = vectors(rows, np.ones(FEATURES, np.float32))
    member = np.argmax(x @ c.T, axis=1).reshape(3, 20)
    assert not set(member[0]) & set(member[1]) and not set(member[1]) & set(member[2])
    assert (least <= 1.0001).all()


@pytest.fixture(scope="module")
def mixed_rows():
    en = "the quick brown fox jumps over the lazy dog and runs away from here"
    de = "der schnelle braune fuchs springt über den faulen hund und läuft davon"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(60)]
    return rows + [
        (100, None, "en"), (101, "", "en"), (102, "123 🙂", "de"), (103, en, None), (None, de, "en"), (104, de.upper(), "xx"),
        (105, en + " " + "z" * 50_000, "en"), (106, "qqq xjq wvz kkj zzq", None),
    ]


def test_edge_rows(spark, mixed_rows):
    df = clashing(spark.createDataFrame(mixed_rows, SCHEMA))
    rows = languages(df).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(mixed_rows)
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0.0
    assert got[103].lang_pred == "en" and got[None].lang_pred == "de" and not got[None].held_out
    assert got[106].rejected and got[106].lang_pred in ("en", "de", "xx")
    assert not got[103].rejected


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "words", None)], SCHEMA)
    assert [tuple(r)[2:4] for r in languages(df).collect()] == [("und", 0.0)]
    assert languages(documents(spark, [])).count() == 0
    assert languages(clashing(documents(spark))).count() == 12
