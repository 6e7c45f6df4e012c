import hashlib
from collections import Counter

import numpy as np
import pytest
from edge import LONG, PROSE, clashing, documents

from veilmeter.llm import suffixes
from veilmeter.llm.shared import MarkTable, marked_in
from veilmeter.llm.suffixes import gram_hashes, owners, repeats, transform

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(rows, length):
    """(doc_id, text) to the result's rows, by counting every window."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum())
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    rows = df.collect()
    for r in rows:
        assert len(r.begins) == len(r.ends) == r.n_spans and sum(r.ends) - sum(r.begins) == r.n_removed
        assert all(b > e for b, e in zip(r.begins[1:], r.ends[:-1], strict=True))
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=repr)


def sample(seed, letters, n=120, most=160):
    """Random texts with passages copied into many others, also overlapping and within one text."""
    rng = np.random.default_rng(seed)
    alphabet = [*"abcdéf漢ghijklmno "][:letters]

    def text(size):
        return "".join(rng.choice(alphabet, size))

    passages = [text(s) for s in (9, 12, 13, 30, 70)]
    rows = []
    for i in range(n):
        t = text(rng.integers(0, most))
        for _ in range(rng.integers(0, 3)):
            p = passages[rng.choice(5, p=[0.1, 0.2, 0.2, 0.2, 0.3])]
            low = rng.integers(0, len(p) // 2)
            at = rng.integers(0, len(t) + 1)
            t = t[:at] + p[low:] + t[at:]
        rows.append((i, t))
    hot = passages[4]
    rows += [(1000 + i, text(6) + hot + text(6)) for i in range(60)]
    rows += [(2000 + i, rows[3][1]) for i in range(4)] + [(5, rows[3][1]), (None, rows[4][1]), (None, None), (7, ""), (8, "ab" * 50), (9, "z" * 11), (10, "y" * 12), (11, "x" * 13)]
    return rows


SCHEMA = "doc_id bigint, text string"


@pytest.mark.parametrize(
    "seed, letters, length, span, gram, strings, block",
    [(1, 17, 12, 4, 5, 8192, 1 << 20), (2, 17, 12, 4, 5, 5, 1 << 20), (3, 4, 13, 8, 6, 6, 64), (4, 2, 12, 3, 10, 4, 100), (5, 6, 20, 16, 7, 50, 41)],
)
def test_equals_brute_force(spark, monkeypatch, seed, letters, length, span, gram, strings, block):
    monkeypatch.setattr(suffixes, "_BLOCK", block)
    rows = sample(seed, letters)
    docs = clashing(spark.createDataFrame(rows, SCHEMA)).repartition(4)
    assert got(repeats(docs, length, span, gram, strings)) == brute(rows, length)


def test_edge_rows(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    extra = [(50, LONG[1000:1399]), (51, LONG[3000:3400] + "."), (52, PROSE * 3), (53, "é" * 200), (54, "é" * 201), (55, LONG[:500] + LONG[:500])]
    docs = clashing(documents(spark)).select("doc_id", "text").unionAll(spark.createDataFrame(extra, SCHEMA))
    assert got(repeats(docs)) == brute(rows + extra, 400)
    assert got(repeats(documents(spark, []))) == []


def test_transform_sorts_suffixes():
    rng = np.random.default_rng(3)
    for letters in (1, 2, 5, 300):
        rows = np.full((40, 9), -1, np.int64)
        for r in rows:
            low, high = sorted(rng.integers(0, 10, 2))
            r[low:high] = rng.integers(0, letters, high - low)
        string, column, common = transform(rows)
        found = [tuple(int(x) for x in rows[i, c:] if x >= 0) for i, c in zip(string, column, strict=True)]
        assert found == sorted(found)
        assert Counter(zip(string.tolist(), column.tolist())) == Counter((i, c) for i in range(40) for c in range(10) if c == 9 or rows[i, c] >= 0)
        for k in range(1, len(found)):
            shared = 0
            while shared < min(len(found[k]), len(found[k - 1])) and found[k][shared] == found[k - 1][shared]:
                shared += 1
            assert common[k] == shared


def test_owners():
    rng = np.random.default_rng(5)
    b = rng.integers(97, 99, 300).astype(np.uint8)
    starts, h = np.array([0, 5, 40, 40, 55, 300]), gram_hashes(b, 4)
    assert len({(int(x), b[i : i + 4].tobytes()) for i, x in enumerate(h)}) == len(set(h.tolist()))
    _, place, first, last = owners(b, starts, 4, 10)
    mine = {s: p for p, a, z in zip(place.tolist(), first.tolist(), last.tolist()) for s in range(a, z + 1)}
    valid = [s for t in range(5) for s in range(starts[t], starts[t + 1] - 9)]
    assert sorted(mine) == valid
    for s in valid:
        low = min(int(x) >> 20 for x in h[s : s + 7])
        assert mine[s] == next(i for i in range(s, s + 7) if int(h[i]) >> 20 == low)


def test_single_anchors_are_dropped(spark, monkeypatch):
    """Least hashes lie close together; in the filter they must not crowd a part of it."""
    rng = np.random.default_rng(7)
    texts = ["".join(map(chr, rng.integers(97, 123, 6000))) for _ in range(90)]
    passages = [t[:3000] for t in texts[:10]]
    rows = list(enumerate(texts + [texts[80 + i][:500] + p for i, p in enumerate(passages)]))
    tables = []
    monkeypatch.setattr(suffixes, "_GRAM_BITS", 15)
    monkeypatch.setattr(suffixes, "written", lambda df, write=suffixes.written: tables.append(write(df)) or tables[-1])
    assert got(repeats(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 400)
    found = next(t for t in tables if "more" in t.columns)
    windows = found.selectExpr("sum(more + 1)").first()[0]
    assert 20 * (3000 - 399) <= windows < 1.15 * 20 * 3000


def test_mark_table(spark):
    rng = np.random.default_rng(9)
    values = np.append(rng.integers(-(2**63), 2**63, 2048), [0, -1, 2**63 - 1, -(2**63)])
    table = MarkTable(spark.createDataFrame([(int(v),) for v in values], "v bigint"), 14).sent.value
    assert marked_in(table, values.view(np.uint64)).all()
    assert marked_in(table, rng.integers(0, 2**64, 100_000, np.uint64)).mean() < 0.04
    empty = MarkTable(spark.createDataFrame([], "v bigint"), 14).sent.value
    assert not marked_in(empty, values.view(np.uint64)).any()
