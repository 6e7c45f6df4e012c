import re
from collections import Counter
from itertools import permutations

import pytest
from edge import LONG, PROSE, answer, clashing, documents

from veilmeter.llm import filters
from veilmeter.llm.filters import FILTERS, failures, filter_orders, matrix

LABELS = "doc_id bigint, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels):
    docs = []
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any(i is not None and doc_id is not None and i < doc_id and (t or "") == text for i, t, *_ in rows)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": smaller,
        }
        own = [x for x in labels if x[0] is not None and x[0] == doc_id]
        docs.append((lang or "", {k for k, v in fails.items() if v}, any(q == 1 for _, q, _ in own), any(t == 1 for _, _, t in own)))
    out = []
    for part in {d[0] for d in docs}:
        here, shapley, lines = [d for d in docs if d[0] == part], Counter(), []
        for order in permutations(FILTERS):
            left = here
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                earlier = set(order[: step - 1])
                redundant = sum(f in d[1] and bool(d[1] & earlier) for d in here)
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                lines.append([part, "".join(order), step, len(left), len(gone), redundant, sum(d[1] == {f} for d in here),
                              sum(d[2] for d in gone), sum(d[3] for d in gone)])
        out += [tuple(x + [shapley[x[1][x[2] - 1]]]) for x in lines]
    return sorted(out, key=repr)


def cases():
    few = " ".join(f"w{i}" for i in range(199))
    many = few + " last"
    return [
        (1, few, "en"), (2, many, "en"), (3, many, "en"), (3, many, "en"), (4, many + " a|b", "en"), (5, many.upper(), "en"),
        (6, " ".join(["a", "b"] * 100), "de"), (7, " ".join(f"x{i % 100}" for i in range(200)), "de"), (8, many, "de"),
        (9, "Ä" * 96 + "ABC " + "b" * 1, "fr"), (10, "é" * 97 + "ABC", "fr"), (11, "é" * 96 + "ABCD", "fr"), (None, many, None), (None, None, None),
        (12, None, ""), (13, "", ""), (14, many + "\x0b\x0c\r\n", "en"), (2, few, "xx"), (15, LONG, "en"), (16, PROSE, "en"),
    ]


LABEL_ROWS = [(2, 1, 0), (2, 0, 1), (3, 1, 1), (4, 1, None), (8, None, 1), (None, 1, 1), (99, 1, 1), (16, 0, 0)]


@pytest.mark.parametrize("size", [1, 3000, filters.SHARD_BYTES])
def test_equals_brute_force(spark, size):
    docs = clashing(spark.createDataFrame(cases(), "doc_id bigint, text string, lang string")).repartition(3)
    got = filter_orders(docs, clashing(spark.createDataFrame(LABEL_ROWS, LABELS)), size)
    assert answer(got, *COLUMNS) == brute(cases(), LABEL_ROWS)


def test_edge_rows(spark):
    rows = [(r[0], r[1], r[2]) for r in documents(spark).collect()]
    got = filter_orders(clashing(documents(spark)), spark.createDataFrame([], LABELS))
    assert answer(got, *COLUMNS) == brute(rows, [])
    assert filter_orders(documents(spark, []), spark.createDataFrame([], LABELS)).count() == 0


def test_matrix_holds_every_word(spark):
    docs = documents(spark).repartition(2)
    shards, dictionary = matrix(docs, 5000)
    rows = dictionary.collect()
    names = {r.word_id: bytes(r.word).decode() for r in rows}
    assert len(names) == len(set(names.values())) == len(rows) > 1000  # every word once, every number once
    got, shards = Counter(), shards.collect()
    assert len(shards) > 2
    for s in shards:
        for i in range(len(s.doc_ids)):
            cells = slice(s.starts[i], s.starts[i + 1])
            got[(s.doc_ids[i], tuple(sorted((names[c], n) for c, n in zip(s.columns[cells], s.counts[cells]))))] += 1
    want = Counter()
    for r in docs.collect():
        words = Counter(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        want[(r.doc_id, tuple(sorted(words.items())))] += 1
    assert got == want


def test_long_texts_in_pieces(spark, monkeypatch):
    text = ("ab  c\tdd\x0be " * 50 + "x" * 40).encode()
    whole = filters._words(text)
    for n in (1, 2, 7, 31, 10_000):
        monkeypatch.setattr(filters, "_PIECE", n)
        assert filters._words(text) == whole


def test_masks(spark):
    rows = {r.doc_id: r.mask for r in failures(spark.createDataFrame(cases(), "doc_id bigint, text string, lang string")).collect()}
    assert (rows[1], rows[6], rows[7], rows[8], rows[10], rows[11], rows[4]) == (1, 2, 0, 0, 1, 5, 8)
