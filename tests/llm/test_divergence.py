import re
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pytest
from edge import answer, clashing, documents

from veilmeter.llm import divergence
from veilmeter.llm.divergence import block_counts, divergences, radix_order, term_counts

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(rows):
    """(text, lang, source) to the result, with Python's whole numbers."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = terms(text)
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang, df in docs.items():
        kept = [t for t, n in df.items() if n >= 10]
        here = {s: c for (g, s), c in groups.items() if g == lang}
        whole = sum(here.values(), Counter())

        def share(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        p, q = {s: share(c) for s, c in here.items()}, share(whole)
        for s in here:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept)) for o in here if o != s]
            best = [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept if here[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", best, 10)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(islice(found, most), 1)]
    return sorted(out, key=repr)


def sample(n=400):
    rng = np.random.default_rng(7)
    words = ["the", "Of", "a", "eightlet", "ninelette", "sixteenletterswo", "seventeenletterss", "ÄÖÜ", "äöü", "漢字漢字漢字漢字", "漢字", "Ab­c",
             "x" * 40, "x" * 41, "y" * 300, "🙂", "don't", "a1b", "tail.end", "\x7f", "@[`{"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    rows = []
    for _ in range(n):
        lang, source = ["en", "de", None, ""][rng.choice(4, p=[0.6, 0.2, 0.1, 0.1])], [*"pqrst", None, ""][rng.integers(7)]
        bias = np.arange(1, len(words) + 1) ** -(0.3 if source in ("p", None) else 1.0)
        text = " ".join(rng.choice(words, rng.integers(0, 60), p=bias / bias.sum()))
        rows.append((text, lang, source))
    rows += [(None, "en", "only null"), ("", "fr", "a"), ("rare words here", "fr", "b"), (None, None, None)] + [("Same Row", "it", "z")] * 12
    return rows


@pytest.mark.parametrize("block, entries, stripe, cells", [(divergence.BLOCK, 1 << 18, 512, 1 << 20), (300, 40, 2, 30)])
def test_equals_brute_force(spark, monkeypatch, block, entries, stripe, cells):
    rows = sample()
    for name, value in (("_ENTRIES", entries), ("_STRIPE", stripe)):
        monkeypatch.setattr(divergence, name, value)
    if stripe == 2:
        # The task's function is shipped with the module's values as they are here.
        monkeypatch.setattr(divergence, "_CELLS", cells)
    docs = clashing(spark.createDataFrame(rows, "text string, lang string, source string")).repartition(5)
    assert answer(divergences(docs, block), *COLUMNS) == brute(rows)


def test_counts(spark):
    rows = sample(150)
    want = defaultdict(lambda: [0, 0])
    for text, lang, source in rows:
        for term, n in Counter(terms(text)).items():
            cell = want[lang or "", source or "", term]
            cell[0] += n
            cell[1] += 1
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    for block in (divergence.BLOCK, 50, 2000):
        got = {(r.lang, r.source, r.term): [r.n, r.docs] for r in term_counts(docs, block).collect()}
        assert got == dict(want)


def test_edge_rows(spark):
    rows = [(r.text, r.lang, r.source) for r in documents(spark).collect()]
    assert answer(divergences(clashing(documents(spark))), *COLUMNS) == brute(rows)
    assert answer(divergences(clashing(documents(spark)).unionAll(clashing(documents(spark, [(1, "a b", "en", "q", 3)] * 10))), 4000), *COLUMNS) == brute(
        rows + [("a b", "en", "q")] * 10
    )
    assert divergences(documents(spark, [])).count() == 0


def test_radix_order():
    rng = np.random.default_rng(1)
    low, high = (rng.integers(0, 3, 5000).astype(np.uint64) << np.uint64(s) for s in (0, 40))
    group = rng.integers(0, 4, 5000).astype(np.uint16)
    assert (radix_order([low, high, group]) == np.lexsort([low, high, group])).all()


def test_block_without_terms():
    assert list(block_counts(np.frombuffer(b"12 34", np.uint8), np.array([0, 5]), np.zeros(1, np.uint16))) == []


def test_large_counts_stay_exact(spark):
    """Counts beyond what a 64-bit product holds."""
    n, total, v = 8 * 10**12, 9 * 10**14, 12_345
    row = spark.sql(f"SELECT {n}L AS n, {total}L AS total, {v}L AS v").select(divergence._share("n", "total", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * v)
