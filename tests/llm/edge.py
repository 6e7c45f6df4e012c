"""Rows every operator on documents must take: nulls, empty and long texts, ties, repeats, odd columns."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000)) + "."
PROSE = "The quick brown fox jumps over the lazy dog while seven other animals look on in quiet surprise."

ROWS = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\f\r ", None, None, 7),
    (4, PROSE, "en", "a", None),
    (4, PROSE, "en", "a", None),
    (5, PROSE, None, None, None),
    (None, PROSE, "en", "a", None),
    (None, None, None, None, None),
    (6, LONG, "en", "b", len(LONG)),
    (7, "1234 5678 ...", "en", "b", 13),
    (8, "Ünïcödé ẞ İstanbul 漢字 🙂 words.", "de", "b", 30),
    (9, "x" * 200_000, "en", "c", 200_000),
]


def documents(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)


def clashing(df):
    """``df`` with columns named like those the operators make."""
    from pyspark.sql import functions as F

    names = ["n_words", "kept", "component_id", "words", "t", "_row", "rate", "slot", "shard", "h", "key", "place", "html"]
    return df.withColumns({n: F.lit("clash") for n in names if n not in df.columns})


def answer(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
