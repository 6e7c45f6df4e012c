import hashlib
import random

from edge import answer

from veilmeter.llm import chats as ch
from veilmeter.llm.chats import chats, maximal

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Maximal conversations by comparing whole turn lists."""
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((t, r, x))
    lists = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    return {
        c: len(v) for c, v in lists.items()
        if not any(
            (len(w) > len(v) and w[: len(v)] == v) or (w == v and d < c) for d, w in lists.items() if d != c
        )
    }


def test_snapshots_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ch, "BLOCK", 3)
    rng = random.Random(2)
    rows, k = [], 0
    for _ in range(30):
        whole = [(t, ("user", "assistant")[t % 2], f"text {rng.randrange(4)}") for t in range(rng.randint(1, 14))]
        for _ in range(rng.randint(1, 4)):
            cut = rng.randint(1, len(whole))
            rows += [(k, *turn) for turn in whole[:cut]]
            k += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert {r.conv_id: r.n_turns for r in maximal(df).collect()} == want
    got = {}
    for r in sorted(chats(df).collect(), key=lambda r: (r.conv_id, r.part)):
        n, text = got.get(r.conv_id, (0, ""))
        got[r.conv_id] = (n + r.n_turns, text + r.chat)
    assert {c: n for c, (n, _) in got.items()} == want
    for c, (_, text) in got.items():
        turns = sorted((t, r, x) for k, t, r, x in rows if k == c)
        assert text == "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, r, x in turns)


def test_edge_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "yes"),
        (2, 0, "user", "hi"),
        (3, 5, "user", "hi"), (3, 9, "assistant", "yes"),  # as 1, with gaps
        (None, 0, "user", "hi"), (None, 1, "assistant", "no"), (None, None, None, None),
        (4, 0, None, "hi"), (5, 0, "user", None), (6, 0, "user", ""),
        (7, 0, "user", "a<|im_end|>b"), (8, 0, "b", "x"), (8, 0, "a", "y"), (9, 0, "user", "z" * 100_000),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("part", "place", "one", "chat", "number")})
    got = {r.conv_id: (r.part, r.n_turns, r.chat) for r in chats(df).collect() if r.conv_id is not None}
    assert set(got) == {1, 4, 5, 7, 8, 9}
    assert got[1] == (0, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n")
    assert got[4][2].startswith("<|im_start|>unknown\n") and got[5][2] == "<|im_start|>user\n<|im_end|>\n"
    assert got[7][2] == "<|im_start|>user\na<im_end>b<|im_end|>\n"
    assert got[8][2].index("<|im_start|>a") < got[8][2].index("<|im_start|>b")
    nameless = answer(chats(df).where("conv_id is null"), "part", "n_turns")
    assert nameless == [(0, 2), (2**62, 1)]


def test_crowded_numbers_are_cut_by_place(spark):
    """Thousands of turns without a number, without a conversation, or that reuse a number."""
    rows = [(None, None, "user", f"nameless {i}") for i in range(3000)]
    rows += [(1, i % 2, ("user", "tool")[i % 3 == 0], f"reused {i}") for i in range(3000)]
    rows += [(2, None, "user", f"open {i}") for i in range(700)] + [(2, 0, "user", "first")]
    rows += [(3, i, "user", f"plain {i}") for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert {r.conv_id: r.n_turns for r in maximal(df).collect()} == {None: 3000, 1: 3000, 2: 701, 3: 700}
    parts = sorted(chats(df).collect(), key=lambda r: (repr(r.conv_id), r.part))
    assert all(r.n_turns <= ch.BLOCK for r in parts)
    assert [(r.part, r.n_turns) for r in parts if r.conv_id == 2] == [(0, 512), (1, 189)]
    assert [(r.part, r.n_turns) for r in parts if r.conv_id == 3] == [(0, 512), (1, 188)]
    for c in (None, 1, 2, 3):
        mine = [(t, r, x) for k, t, r, x in rows if k == c]
        mine.sort(key=lambda m: (2**62 if m[0] is None else m[0], m[1], hashlib.md5(m[2].encode()).hexdigest()))
        want = "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, r, x in mine)
        assert "".join(r.chat for r in parts if r.conv_id == c) == want


def test_empty_table(spark):
    assert chats(spark.createDataFrame([], SCHEMA)).count() == 0
