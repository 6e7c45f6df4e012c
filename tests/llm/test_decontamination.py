import itertools
import random

import numpy as np
import pyarrow as pa
from edge import PROSE, answer, clashing, documents

from veilmeter.llm import decontamination as dc
from veilmeter.llm.decontamination import leaks, without_leaks
from veilmeter.llm.tokens import word_hashes

ITEMS = "item_id long, text string"


def brute(docs, items):
    """Every alignment with a common word, judged in plain Python."""
    words = lambda rows: [(i, w.tolist()) for (i, _), w in zip(rows, word_hashes(pa.array([t for _, t in rows], pa.string())), strict=True)]
    found = set()
    for i, d in words(docs):
        for k, b in words(items):
            if len(b) < dc.LEAST:
                continue
            places = {}
            for y, w in enumerate(b):
                places.setdefault(w, []).append(y)
            shifts = {x - y for x, w in enumerate(d) for y in places.get(w, ())}
            size = min(dc.VERIFY, len(b))
            masks = dc.MASKS if len(b) >= dc.SPAN else ["1" * len(b)]
            for s in shifts:
                for x in range(max(0, s), min(len(d), s + len(b)) - size + 1):
                    equal = [d[x + j] == b[x + j - s] for j in range(size)]
                    if 100 * sum(equal) < dc.AGREE * size:
                        continue
                    if any(
                        all(equal[at + j] for j, c in enumerate(m) if c == "1")
                        for m in masks for at in range(size - len(m) + 1)
                    ):
                        found.add((i, k))
    return found


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = leaks(docs, items)
    assert want and {(r.doc_id, r.item_id) for r in got.collect()} == want
    left = without_leaks(docs, items)
    assert left.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in left.collect()} == {d for d, _ in want}


def test_substitutions(spark):
    rng = random.Random(5)
    word = lambda: f"q{rng.randrange(500)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([4, 5, 9, 11, 12, 15, 19, 20, 40, 90])]
    docs = []
    for k, text in items:
        for changes in range(0, 9):
            w = text.split()
            for _ in range(changes):
                w[rng.randrange(len(w))] = word()
            docs.append((100 * k + changes, " ".join([word() for _ in range(30)] + w + [word() for _ in range(30)])))
            docs.append((100 * k + 50 + changes, " ".join(w)))
    want = brute(docs, items)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(frame, spark.createDataFrame(items, ITEMS)).collect()}
    assert got == want
    assert {(100 * k, k) for k in range(1, 10)} <= got  # whole copies, but for the item of four words
    assert not any(k == 0 for _, k in got)


def test_edge_rows(spark):
    items = spark.createDataFrame([(1, PROSE), (1, PROSE), (2, PROSE.upper()), (3, None), (4, ""), (None, PROSE), (5, "a b")], ITEMS)
    items = clashing(items)
    docs = clashing(documents(spark))
    got = answer(leaks(docs, items), "doc_id", "item_id", "n_equal", "at")
    n = len(PROSE.split())
    assert got == sorted([(d, i, n, 0) for d in (4, 5, None) for i in (1, 2, None)], key=repr)
    assert {r.doc_id for r in without_leaks(docs, items).collect()} == {1, 2, 3, 6, 7, 8, 9, None}


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, PROSE)], ITEMS)
    assert leaks(documents(spark), none).count() == 0
    assert leaks(documents(spark, []), some).count() == 0
    assert without_leaks(documents(spark), none).count() == 12


def test_place_in_long_text(spark):
    text = " ".join(["filler"] * 5000) + " " + PROSE + " " + " ".join(["filler"] * 10)
    got = leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, PROSE)], ITEMS))
    assert [tuple(r) for r in got.collect()] == [(1, 7, len(PROSE.split()), 5000)]


def test_masks():
    assert all(len(m) == dc.SPAN and m.count("1") == 8 and m[0] == m[-1] == "1" for m in dc.MASKS)
    w = np.arange(40, dtype=np.uint64)
    changed = w.copy()
    changed[2] = 99  # ignored by the first mask at place 0
    assert dc._hashes(w, 0)[0] == dc._hashes(changed, 0)[0]
    assert dc._hashes(w, 1)[0] != dc._hashes(changed, 1)[0]


def missed(n, k):
    """Ways to replace k of n words that leave no seed of the item whole."""
    placed = {tuple(at + o for o in dc.SEEDS[s]) for s in dc.seeds_of(n) for at in range(n - dc._length(s) + 1)}
    bits = np.array([sum(1 << o for o in places) for places in placed])
    return sum((bits & sum(1 << o for o in gone) != 0).all() for gone in itertools.combinations(range(n), k))


def test_every_pattern_of_replaced_words_is_hit():
    for n in range(dc.LONGER, dc.VERIFY + 1):
        assert missed(n, n - -(-dc.AGREE * n // 100)) == 0, n
    assert [missed(10, 1), missed(10, 2), missed(11, 1), missed(11, 2)] == [2, 24, 0, 7]  # as documented


def test_hashes_by_difference():
    words = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    for s, h in dc._every_hash(words, list(range(len(dc.SEEDS)))):
        assert (h == dc._hashes(words, s)).all()


def test_short_items_with_replaced_words(spark):
    """Every placement of two replaced words in an item of 12 words, inside a longer text."""
    item = [f"i{k}" for k in range(12)]
    docs = []
    for i, replaced in enumerate(itertools.combinations(range(12), 2)):
        w = [f"x{k}" if k in replaced else x for k, x in enumerate(item)]
        docs.append((i, " ".join([f"a{k}" for k in range(30)] + w + [f"b{k}" for k in range(30)])))
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], ITEMS))
    assert sorted((r.doc_id, r.n_equal, r.at) for r in got.collect()) == [(i, 10, 30) for i in range(66)]
