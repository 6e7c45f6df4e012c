import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from veilmeter.llm import tokens
from veilmeter.llm.tokens import mix, windows, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return WORD.findall((text or "").translate(LOWER))


def agree(texts):
    """Equal words get equal hashes and different words different ones."""
    seen = {}
    for text, hashes in zip(texts, word_hashes(pa.array(texts, pa.string())), strict=True):
        words = plain(text)
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZé🙂\x85\xa0 \t\n\x0b\f\r.,", max_size=40)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    agree(texts)


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 64)
    agree(["ab " * 500, "x" * 1000, "y" * 100 + " " + "z" * 300 + "  end", None, "", "one two"])


def test_sliced_arrays_and_nulls():
    whole = pa.array(["zero", None, "a b", "c"], pa.string())
    assert [len(x) for x in word_hashes(whole.slice(1, 2))] == [0, 2]


def test_windows():
    words = mix(np.arange(7, dtype=np.uint64))
    assert len(windows(words, 5)) == 3
    assert len(windows(words[:4], 5)) == 1
    assert windows(words[:4], 5)[0] != windows(words[:4][::-1], 5)[0]
    assert len(windows(words[:0], 5)) == 0
    assert windows(words[:5], 5)[0] == windows(words, 5)[0]
