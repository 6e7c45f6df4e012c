import random

import numpy as np
import pytest
from edge import answer, clashing, documents

from veilmeter.llm import near_copies as nc
from veilmeter.llm.near_copies import near_copies, one_of_each
from veilmeter.llm.shared import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Component of every doc_id by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() if len(h) < 400 for a in h for b in h if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 3000):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        assert len(nc.sketch(x)) == nc.BINS and len(set(nc.sketch(x).tolist())) >= min(n, 20) // 2
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:750], rng.integers(0, 2**63, 250, dtype=np.uint64)])
    same = [np.mean(nc.sketch(a ^ np.uint64(k)) == nc.sketch(b ^ np.uint64(k))) for k in range(20)]
    assert abs(np.mean(same) - 0.6) < 0.02 and np.std(same) < 0.05


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, sizes = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = near_copies(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edge_rows(spark):
    docs = clashing(documents(spark))
    got = answer(near_copies(docs))
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and (3, 0, 3, True) in got
    assert got.count((4, 14, 4, True)) == 2  # a repeated row, one document
    assert (5, 14, 4, False) in got
    assert (None, 14, None, True) in got and (None, 0, None, True) in got
    assert len(got) == 12
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 7, 8, 9]
    assert kept.where("doc_id is null").count() == 2


def test_empty_table(spark):
    assert near_copies(documents(spark, [])).count() == 0


def test_large_groups(spark, monkeypatch):
    """Copies, near copies of one text with more and fewer edits, texts that share one passage."""
    monkeypatch.setattr(nc, "BLOCK", 16)
    monkeypatch.setattr(nc, "BIG", 20)
    monkeypatch.setattr(nc, "CHUNK", 8)
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(4000)]
    word = lambda: rng.choice(vocabulary)
    first = [word() for _ in range(120)]
    rows = [(0, " ".join(first))]
    for i in range(1, 220):
        edited = list(first)
        for _ in range(rng.randint(1, 8)):
            edited[rng.randrange(120)] = word()
        rows.append((i, " ".join(edited)))
    rows += [(1000 + i, " ".join(first).upper()) for i in range(150)]
    passage = [word() for _ in range(60)]
    rows += [(2000 + i, " ".join(passage + [word() for _ in range(rng.randint(10, 60))])) for i in range(120)]
    want, _ = brute_without_limit(rows)
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def brute_without_limit(rows):
    """As ``brute``, with equal sets compared once."""
    least, sets = {}, {}
    for i, t in rows:
        s = shingles(t)
        least[s] = min(i, least.get(s, i))
        sets[i] = s
    one = [(least[s], s) for s in least]
    parent = {i: i for i, _ in one}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(one):
        for b, t in one[:k]:
            common = len(s & t)
            if 100 * common >= 75 * (len(s) + len(t) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(least[s]) for i, s in sets.items()}, None


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (9, 8)], [(i, i + 1) for i in range(40)], [(5, 5), (1, 2), (1, 2)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in parent:
        for a, b in edges:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
