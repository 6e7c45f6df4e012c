import re
import textwrap
from collections import Counter

import pytest
from edge import LONG, PROSE, answer, clashing, documents

from veilmeter.llm.quality import cleaned, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """The base columns in plain Python."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {k for i, w in enumerate(windows) if seen[w] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    extra = ["a b c d e " * 30, "a a a a a a", "x\n\nx\n x\nx", "🙂 𝔘 \u0085   é" * 4, "l1\r\nl1\r\nl2", "a b c d e f a b c d e"]
    texts |= {10**6 + i: t for i, t in enumerate(extra)}
    got = quality(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == {i: base(t) for i, t in texts.items()}


def long_lines(n):
    return [f"Line {i} of the tale holds " + " ".join(f"word{i}x{j}" for j in range(14)) + "." for i in range(n)]


@pytest.mark.parametrize(
    "lines,kept",
    [
        (long_lines(6), True),
        (long_lines(6) + ["Home | News | Sport | Weather | Contact"], True),
        (long_lines(1) + ["Home | News | Sport | Weather | Contact | Jobs | Press | Terms | Shop"] * 1, False),
        (["BUY NOW!! THIS IS THE BEST OFFER!! ONLY TODAY!! CALL US NOW!! " + " ".join(f"SALE{i}" for i in range(20))], False),
        (["The*** price%%% of&&& every$$$ thing*** is%%% high$$$ and*** goes&&& up%%% all*** day$$$ long***."], False),
        (["one two three four five six seven eight nine ten eleven twelve without any end of the line"], False),
        (["NASA and ESA met in Rome. The talks, held on 5 May, went well. Both sides agreed to meet again."], True),
        (long_lines(2) + ["Click here to read more", "All rights reserved", "We use cookies."], True),
    ],
)
def test_line_rules(spark, lines, kept):
    text = "\n".join(lines)
    got = quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert got.kept == kept and not got.base_failed


def test_wrapped_copies_of_clean_texts(spark):
    """Lines broken at 72 columns are judged as the paragraph they belong to."""
    folder = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1 and toxic = 0")
    rows = quality(spark.read.parquet(f"{folder}/documents.parquet").join(good, "doc_id", "left_semi"))
    texts = [r.clean_text for r in rows.where("kept and n_lost_lines = 0").limit(100).collect()]
    copies = [(i, "\n".join(textwrap.fill(x, 72) for x in t.split("\n"))) for i, t in enumerate(texts)]
    got = quality(spark.createDataFrame(copies, "doc_id long, text string"))
    assert len(texts) == 100
    assert [(r.doc_id, r.clean_text) for r in got.where("kept").orderBy("doc_id").collect()] == copies


def test_paragraphs_and_marks_of_other_scripts(spark):
    plain = " ".join(f"word{i}" for i in range(10))
    nouns = textwrap.fill("Gestern ging der alte Mann mit seinem Hund durch den Wald bei Bonn und sah dort viele Vögel, die sangen. " * 2, 36)
    texts = [
        plain + "\n\nand a paragraph of its own.",  # parted by a blank line
        plain + "\n- and an item of a list.",
        plain + "\nAnother sentence, not wrapped.",
        plain + "\nHOME NEWS SPORT AND WEATHER\nand so on.",  # parted by a failing line
        plain + "\nand so on.",
        nouns,
        *[plain + mark for mark in ("।", "؟", "۔", "！", "？")],
        f"{plain}：{plain}",
    ]
    got = quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_lost_lines for r in got] == [1, 1, 1, 2, 0, 0, 0, 0, 0, 0, 0, 0]


def test_cleaned_text(spark):
    lines = long_lines(6)
    noisy = [lines[0], "Home | News | Sport | Weather", *lines[1:4], "Click here to subscribe", *lines[4:]]
    docs = spark.createDataFrame([(1, "\n".join(noisy), 5)], "doc_id long, text string, n_chars long")
    got = cleaned(docs).collect()
    assert [tuple(r) for r in got] == [(1, "\n".join(lines), len("\n".join(lines)))]


def test_labels_agree(spark):
    """Documents labelled good pass unless the base rules fail them; nearly all poor ones do not."""
    folder = "/root/testdata/sf0.01"
    judged = quality(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = judged.select("quality", "base_failed", "kept").collect()
    assert all(r.kept or r.base_failed for r in rows if r.quality == 1)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.02 * sum(r.quality == 0 for r in rows)


def test_edge_rows(spark):
    docs = clashing(documents(spark))
    got = answer(quality(docs), "doc_id", *COLUMNS, "kept")
    assert got.count((1, 0, 0, 0, 0, 0, True, False)) == 1
    prose = (len(PROSE.split()), len(PROSE.replace(" ", "")), 0, 0, 0, False, True)
    assert got.count((4, *prose)) == 2 and (None, *prose) in got
    assert (6, *base(LONG), True) in got or (6, *base(LONG), False) in got
    assert len(got) == 12
    kept = cleaned(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {4, 5, None}
    assert quality(documents(spark, [])).count() == 0
