"""Quality rules for documents, applied line by line before the document is judged (operator 4).

A line with a word fails if it

- shouts: at least ``SHOUT`` percent of its characters are capital letters (three words at least);
- navigates: three or more separators, ``MENU`` percent of its characters at least;
- is symbols: three or more of ``# * $ % & | < >``, ``SYMBOLS`` percent of its characters at least;
- is boilerplate: names a phrase of ``BOILERPLATE`` and has at most ``SHORT`` words;
- has no punctuation: it has more than ``HEADING`` words, and no word of the paragraph it stands in
  ends a clause.

A line goes on in the next one, in the same paragraph, if that begins with a small letter or one
without case. Where at least ``FLOWING`` percent of the line breaks are such, the text is wrapped, and
there a line goes on whatever the next one begins with. Blank lines, bullets and lines that fail by
another rule part paragraphs always.

Failing lines go. A document that loses more than ``LOSS`` percent of its words, or that fails the
base rules (too few words, too many in repeated runs of five), is rejected. Everything is computed
inside the row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import one_row, own

SPACES = "\t\n\x0b\f\r"
CAPITALS = "[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]"
MARKS, SEPARATORS = "#*$%&|<>", "|»›•·"
#: Full-width marks end a clause wherever they stand, as no space follows them.
CLAUSE_END = "[.!?:;…。।॥؟۔؛።፧။։‽][\"')\\]”’»]*([ \\t\\x0b\\f\\r]|$)|[。！？；：．｡]"
GOES_ON = r"^[ \t\x0b\f\r]*[\p{Ll}\p{Lo}]"
BULLET = r"^[ \t]*([-*•·–—▪◦‣+>#|]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)])[ \t]"
FILLED = r"[^\x20\x09-\x0D]"
SHOUT, MENU, SYMBOLS, SHORT, HEADING, LOSS, FLOWING = 33, 4, 10, 25, 8, 30, 25
ENDS, BARE = 1, 2
RUN, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
# Fixed phrases of page furniture, lower case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "we use cookies", "accept cookies", "enable javascript", "click here", "read more", "sign in",
    "sign up", "log in to", "login to", "subscribe to our", "share this", "skip to content",
    "back to top", "lorem ipsum", "related articles", "leave a comment",
)


def word_array(text: Column) -> Column:
    """Runs of anything but space and U+0009 to U+000D."""
    for c in SPACES:  # byte search, much faster than a regular expression or translate
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def count_of(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def line_marks(line: Column, marked: Column, furnished: Column) -> Column:
    """Of a line: ``bad``, it fails by itself; ``kind``, ENDS a clause, or BARE: it does not, and has
    more words than a heading.

    ``marked``, ``furnished``: whether the text has three symbols or separators, or a phrase, at all.
    """
    words = F.size(word_array(line))
    length = F.length(line)
    separators, symbols = count_of(line, SEPARATORS), count_of(line, MARKS)
    shouts = (F.regexp_count(line, F.lit(CAPITALS)) * 100 >= length * SHOUT) & (words >= 3)
    navigates = (separators >= 3) & (separators * 100 >= length * MENU)
    symbolic = (symbols >= 3) & (symbols * 100 >= length * SYMBOLS)
    bad = (marked & (navigates | symbolic)) | shouts | (furnished & has_phrase(F.lower(line)) & (words <= SHORT))
    kind = F.when(F.rlike(line, F.lit(CLAUSE_END)), ENDS).when(words > HEADING, BARE).otherwise(0)
    return F.struct(bad.alias("bad"), kind.alias("kind"))


def _paragraph_starts(lines: Column, marks: Column) -> Column:
    """Places of the lines that do not go on with a paragraph."""
    join = F.transform(  # to the line before: 2 by its first letter, 1 if the text is wrapped
        lines,
        lambda x, i: F.when(i == 0, 0)
        .when(F.get(marks, i)["bad"] | F.get(marks, i - 1)["bad"], 0)
        .when(~F.rlike(F.get(lines, i - 1), F.lit(FILLED)) | ~F.rlike(x, F.lit(FILLED)) | F.rlike(x, F.lit(BULLET)), 0)
        .when(F.rlike(x, F.lit(GOES_ON)), 2)
        .otherwise(1),
    )
    zero = F.struct(F.lit(0).alias("small"), F.lit(0).alias("all"))
    wrapped = F.aggregate(
        join,
        zero,
        lambda n, x: F.struct((n["small"] + (x == 2).cast("int")).alias("small"), (n["all"] + (x > 0).cast("int")).alias("all")),
        lambda n: (n["small"] > 0) & (100 * n["small"] >= FLOWING * n["all"]),
    )
    least = F.struct(F.when(wrapped, 1).otherwise(2).alias("least"), join.alias("join"))
    # A one-element array, so that the joins are worked out once.
    starts = F.transform(
        F.array(least),
        lambda y: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(y["join"], i) < y["least"]),
    )
    return F.get(starts, F.lit(0))


def _fails(marks: Column, starts: Column) -> Column:
    """Failing lines, where paragraphs begin at ``starts``."""

    def paragraph(begin: Column, k: Column) -> Column:
        part = F.slice(marks, begin + 1, F.coalesce(F.get(starts, k + 1), F.size(marks)) - begin)
        ends = F.exists(part, lambda m: m["kind"] == ENDS)
        return F.when(ends, F.transform(part, lambda m: m["bad"])).otherwise(
            F.transform(part, lambda m: m["bad"] | (m["kind"] == BARE))
        )

    return F.flatten(F.transform(starts, paragraph))


def has_phrase(low: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(low, F.lit(phrase))
    return found


def repeated_words(grams: Column, ordered: Column) -> Column:
    """Words inside windows that occur twice; ``ordered`` holds (hash, place) sorted."""
    same = lambda k, j: F.get(ordered, k)["h"] == F.get(ordered, j)["h"]
    places = F.filter(
        F.sequence(F.lit(0), F.size(ordered) - 1),
        lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)),
    )
    starts = F.sort_array(F.transform(places, lambda k: F.get(ordered, k)["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-RUN).alias("last"))
    covered = F.aggregate(
        starts,
        zero,
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(RUN), x - acc["last"])).alias("n"), x.alias("last")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(ordered) == 0, 0).otherwise(covered)


def quality(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_lost_words, n_lost_lines, clean_text.

    A null text counts as empty, has no word, fails the base rules and stays null in clean_text.
    Null doc_ids and repeated rows are judged like any other row; other columns are ignored.
    """
    return _judged(own(docs, "doc_id", "text"), "doc_id")


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failing lines; ``n_chars`` follows the text."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    passed = _judged(packed, "_row").where("kept")
    changed = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("bigint")}
    return passed.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def _judged(rows: DataFrame, carried: str) -> DataFrame:
    """Verdicts on the column ``text``; the column ``carried`` stays."""
    rows = rows.withColumn("t", F.coalesce("text", F.lit("")))
    rows = one_row(
        rows,
        words=word_array(F.col("t")),
        lines=F.split("t", "\n"),
        symbols=count_of(F.col("t"), MARKS),
        furnished=has_phrase(F.lower("t")),
    )
    rows = one_row(rows, marked=(F.col("symbols") >= 3) | (count_of(F.col("t"), SEPARATORS) >= 3))
    last = F.size("words") - RUN
    window = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(RUN)]),
    )
    rows = one_row(
        rows,
        grams=F.when(last >= 0, window).otherwise(F.array().cast("array<bigint>")),
        filled=F.filter("lines", lambda x: F.rlike(x, F.lit(FILLED))),
        marks=F.transform("lines", lambda x: line_marks(x, F.col("marked"), F.col("furnished"))),
    )
    bare = F.exists("marks", lambda m: m["kind"] == BARE)
    rows = one_row(rows, starts=F.when(bare, _paragraph_starts(F.col("lines"), F.col("marks"))))
    each = F.transform("marks", lambda m: m["bad"])
    rows = one_row(rows, fails=F.when(F.col("starts").isNull(), each).otherwise(_fails(F.col("marks"), F.col("starts"))))
    rows = one_row(rows, failed=F.filter("lines", lambda x, i: F.get("fails", i)))
    pairs = F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = one_row(
        rows,
        ordered=F.when(F.size(F.array_distinct("grams")) < F.size("grams"), pairs).otherwise(nothing),
        lost=F.array_join("failed", " "),
        clean=F.when(F.size("failed") == 0, F.col("text")).otherwise(
            F.array_join(F.filter("lines", lambda x, i: ~F.get("fails", i)), "\n")
        ),
    )
    rows = rows.select(
        carried,
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.col("symbols").cast("bigint").alias("n_symbols"),
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("grams"), F.col("ordered")).cast("bigint").alias("n_repeat_words"),
        F.size(word_array(F.col("lost"))).cast("bigint").alias("n_lost_words"),
        F.size("failed").cast("bigint").alias("n_lost_lines"),
        F.col("clean").alias("clean_text"),
    )
    rows = one_row(
        rows,
        base_failed=(F.col("n_words") < LEAST_WORDS)
        | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
    )
    return rows.select(
        carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (100 * F.col("n_lost_words") <= LOSS * F.col("n_words"))).alias("kept"),
        "n_lost_words", "n_lost_lines", "clean_text",
    )


#: The same for texts whose lines end where their sentences do, as in the given tables: every line is a
#: paragraph, and no marks of other scripts.
QUALITY_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS filled
  FROM t),
g AS (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w),
h AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS gram FROM g),
d AS (SELECT r, i FROM h QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
p AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM d) GROUP BY r),
l AS (
  SELECT r, x, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS ws
  FROM (SELECT r, unnest(filled) AS x FROM w)),
f AS (
  SELECT r, count(*) AS n, sum(len(ws)) AS words FROM l WHERE
    (length(regexp_replace(x, '[^|»›•·]', '', 'g')) >= 3
       AND 100 * length(regexp_replace(x, '[^|»›•·]', '', 'g')) >= 4 * length(x))
    OR (length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) >= 3
       AND 100 * length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) >= 10 * length(x))
    OR (len(ws) >= 3 AND 100 * length(regexp_replace(x, '[^A-ZÀ-ÖØ-ÞΑ-ΩА-Я]', '', 'g')) >= 33 * length(x))
    OR (len(ws) <= 25 AND regexp_matches(lower(x), 'BOILERPLATE'))
    OR (len(ws) > 8 AND NOT regexp_matches(x, '[.!?:;…。]["'')\]”’»]*([ \t\x0b\f\r]|$)'))
  GROUP BY r),
s AS (
  SELECT doc_id, len(w.words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(filled) - len(list_distinct(filled)) AS n_dup_lines,
         coalesce(p.n, 0) AS n_repeat_words, coalesce(f.words, 0)::BIGINT AS n_lost_words,
         coalesce(f.n, 0) AS n_lost_lines
  FROM w LEFT JOIN p USING (r) LEFT JOIN f USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_lost_words <= 30 * n_words AS kept,
       n_lost_words, n_lost_lines
FROM s
""".replace("BOILERPLATE", "|".join(BOILERPLATE))
