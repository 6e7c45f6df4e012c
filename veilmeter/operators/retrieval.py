"""Documents and hybrid retrieval: normalise, chunk, supersede, search, fuse, refuse."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import computed_once, let
from . import vectors

CANDIDATES = 40
FUSION_K = 60
TOP = 6
# Chunk sizes in words: steps of STEP, OVERLAP words shared (15%), the last chunk takes the rest,
# so every chunk of a section with at least STEP words has 400 to 800.
STEP, OVERLAP = 400, 70
_SPACE = r"[ \t\n\r\f\x0B]+"


@F.pandas_udf(ArrayType(StringType()))
def nfc(pieces: pd.Series) -> pd.Series:
    """Unicode NFC of each piece; there is no built-in function for it."""
    return pieces.map(lambda ps: [unicodedata.normalize("NFC", p) for p in ps])


#: Characters from U+0300 with the one before them, which their first may combine with.
_MARKED = r"(?s)[\x{0}-\x{2ff}]?[\x{300}-\x{10ffff}]+"


def normalise(df: DataFrame, text: str = "text") -> DataFrame:
    """Text in NFC. Characters below U+0300 are normal and combine with none before them: what
    lies between two marked pieces skips Python."""
    other = ~F.col(text).rlike(r"^[\x00-\x{2ff}]*$")
    pieces = nfc(F.regexp_extract_all(F.col(text), F.lit(_MARKED), 0))
    whole = F.zip_with(F.split(F.col(text), _MARKED, -1), pieces, lambda before, piece: F.concat(before, F.coalesce(piece, F.lit(""))))
    marked = df.filter(other).withColumn(text, F.array_join(whole, ""))
    return df.filter(~F.coalesce(other, F.lit(False))).unionByName(marked)


_HEADING = r"^(#{1,6})[ \t]+(.*?)[ \t\r]*$"
_TITLES = "array<struct<level:int,title:string>>"
_CHUNK = 256


def _paths(heads: Column) -> Column:
    """Path of all open headings at each heading. Folded in chunks: no array grows beyond its chunk."""

    def step(acc: Column, head: Column) -> Column:
        kept = F.filter(acc["open"], lambda h: h["level"] < head["level"])
        opened = F.concat(kept, F.array(F.struct(head["level"].alias("level"), head["title"].alias("title"))))
        path = F.array_join(F.transform(opened, lambda h: h["title"]), " › ")
        return F.struct(opened.alias("open"), F.concat(acc["paths"], F.array(path)).alias("paths"))

    def chunk_step(acc: Column, part: Column) -> Column:
        start = F.struct(acc["open"].alias("open"), F.array().cast("array<string>").alias("paths"))
        return let(
            F.aggregate(part, start, step),
            lambda r: F.struct(r["open"].alias("open"), F.concat(acc["done"], F.array(r["paths"])).alias("done")),
        )

    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(heads) / _CHUNK).cast("int") - 1, F.lit(0))),
        lambda k: F.slice(heads, k * _CHUNK + 1, F.lit(_CHUNK)),
    )
    zero = F.struct(F.array().cast(_TITLES).alias("open"), F.array().cast("array<array<string>>").alias("done"))
    return F.flatten(F.aggregate(parts, zero, chunk_step, lambda acc: acc["done"]))


def sections(text: Column) -> Column:
    """Sections of a text as (heading_path, body), split at lines of one to six ``#``.

    A heading closes deeper and equal ones, so the path names all open headings.
    """

    def head(line: Column, i: Column) -> Column:
        level = F.length(F.regexp_extract(line, _HEADING, 1))
        title = F.regexp_extract(line, _HEADING, 2)
        return F.struct(i.alias("at"), level.alias("level"), title.alias("title"))

    def cut(lines: Column, heads: Column, paths: Column) -> Column:
        def section(k: Column) -> Column:
            begin = F.when(k == 0, F.lit(0)).otherwise(F.get(heads, k - 1)["at"] + 1)
            end = F.coalesce(F.get(heads, k)["at"], F.size(lines))
            return F.struct(
                F.when(k == 0, F.lit("")).otherwise(F.get(paths, k - 1)).alias("heading_path"),
                F.array_join(F.slice(lines, begin + 1, end - begin), "\n").alias("body"),
            )

        return F.transform(F.sequence(F.lit(0), F.size(heads)), section)

    def of(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, head), lambda h: h["level"] > 0)
        return let(heads, lambda h: let(_paths(h), lambda p: cut(lines, h, p)))

    return let(F.split(text, "\n"), of)


def chunk(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Chunks of every section: keys, section_no, chunk_no, heading_path, n_words, content."""
    found = computed_once(df.select(*keys, text), {"_sections": sections(F.col(text))})
    parts = found.select(*keys, F.posexplode("_sections").alias("section_no", "s"))
    trimmed = F.regexp_replace(F.col("s.body"), rf"^{_SPACE}|{_SPACE}$", "")
    words = computed_once(
        parts.select(*keys, "section_no", "s.heading_path", trimmed.alias("_body")).filter("_body <> ''"),
        {"_words": F.split("_body", _SPACE)},
    )
    n = F.size("_words")
    last = F.greatest(F.floor(n / STEP).cast("int") - 1, F.lit(0))

    def piece(i: Column) -> Column:
        length = F.when(i == last, n - i * STEP).otherwise(F.lit(STEP + OVERLAP))
        return F.slice("_words", i * STEP + 1, length)

    cut = computed_once(words, {"_pieces": F.transform(F.sequence(F.lit(0), last), piece)})
    chunks = cut.select(
        *keys, "section_no", "heading_path", F.posexplode("_pieces").alias("chunk_no", "_piece")
    )
    return chunks.select(
        *keys, "section_no", "chunk_no", "heading_path", F.size("_piece").alias("n_words"),
        F.array_join("_piece", " ").alias("content"),
    )


def current_versions(documents: DataFrame, key: str, version: str = "version") -> DataFrame:
    """Newest ready version of each document; a new version counts once it is ready."""
    newest = documents.filter("status = 'ready'").groupBy(key).agg(F.max(version).alias(version))
    return documents.filter("status = 'ready'").join(newest, [key, version], "left_semi")


def visible_chunks(chunks: DataFrame) -> DataFrame:
    """What retrieval may ever return."""
    return chunks.filter(~F.col("quarantined"))


def _membership(lists: pd.Series, place: dict) -> np.ndarray:
    """A row for each list, a column for each known group."""
    sizes = lists.map(len).to_numpy()
    rows = np.repeat(np.arange(len(lists)), sizes)
    columns = pd.Series([g for one in lists for g in one], dtype=object).map(place)
    known = columns.notna().to_numpy()
    out = np.zeros((len(lists), len(place)), np.float32)
    out[rows[known], columns[known].astype(int).to_numpy()] = 1
    return out


def readable(left: pd.DataFrame, queries: pd.DataFrame) -> np.ndarray:
    """Chunks and questions that share a group, as a product of two memberships."""
    place = {g: i for i, g in enumerate(dict.fromkeys(g for one in queries["groups"] for g in one))}
    return _membership(left["acl_groups"], place) @ _membership(queries["groups"], place).T > 0


def vector_branch(chunks: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Best ``k`` chunks per question by cosine: own tenant, readable, not quarantined.

    ``chunks`` holds tenant_id, id, vector, acl_groups, quarantined; ``queries`` tenant_id, id,
    vector, groups. Access is checked before anything is scored as a candidate.
    """
    left = visible_chunks(chunks).select("tenant_id", "id", "vector", "acl_groups")
    right = queries.select("tenant_id", "id", "vector", "groups")
    found = vectors.best_partners(left, right, ["tenant_id"], k, allowed=readable)
    return found.select(
        F.col("right_id").alias("query_id"), F.col("left_id").alias("chunk_id"), "score", "rank"
    )


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def asked_terms(queries: DataFrame) -> DataFrame:
    """(tenant_id, query_id, groups, n_terms, term) of questions (tenant_id, id, groups, question)."""
    asked = queries.select(
        "tenant_id", F.col("id").alias("query_id"), "groups",
        F.array_distinct(terms(F.col("question"))).alias("_terms"),
    )
    return asked.select(
        "tenant_id", "query_id", "groups", F.size("_terms").alias("n_terms"),
        F.explode("_terms").alias("term"),
    )


def term_table(chunks: DataFrame, text: str = "content", only: DataFrame | None = None) -> DataFrame:
    """Inverted index rows (tenant_id, id, acl_groups, term, tf) of visible chunks.

    ``only`` (tenant_id, term) keeps the index to terms that are asked for; without it the result
    is an index worth storing.
    """
    split = computed_once(
        visible_chunks(chunks).select("tenant_id", "id", "acl_groups", F.col(text).alias("_text")),
        {"_terms": terms(F.col("_text"))},
    )
    words = split.select("tenant_id", "id", "acl_groups", F.explode("_terms").alias("term"))
    if only is not None:
        words = words.join(only.select("tenant_id", "term").distinct(), ["tenant_id", "term"], "left_semi")
    return words.groupBy("tenant_id", "id", "acl_groups", "term").agg(F.count(F.lit(1)).alias("tf"))


def keyword_branch(index: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Best ``k`` chunks per question that contain all its terms, by summed term frequency.

    ``queries`` holds tenant_id, id, groups, question. A chunk's terms only meet questions that
    ask for them.
    """
    wanted = asked_terms(queries)
    hits = (
        index.join(wanted, ["tenant_id", "term"])
        .filter(F.arrays_overlap("acl_groups", "groups"))
        .groupBy("query_id", F.col("id").alias("chunk_id"))
        .agg(F.sum("tf").alias("score"), F.count(F.lit(1)).alias("_found"),
             F.first("n_terms").alias("n_terms"))
        .filter(F.col("_found") == F.col("n_terms"))
    )
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    ranked = hits.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def fuse(*lists: DataFrame, k: int = FUSION_K) -> DataFrame:
    """Reciprocal rank fusion of ranked candidate lists."""
    every = lists[0].select("query_id", "chunk_id", "rank")
    for more in lists[1:]:
        every = every.unionByName(more.select("query_id", "chunk_id", "rank"))
    fused = every.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score")
    )
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w))


def answer_context(fused: DataFrame, threshold: float, top: int = TOP) -> DataFrame:
    """The numbered sources of each question; a question whose best score is low is refused."""
    best = fused.groupBy("query_id").agg(F.max("score").alias("best"))
    grounded = best.withColumn("refused", F.col("best") < threshold)
    return fused.filter(F.col("rank") <= top).join(grounded, "query_id")


def conflict_candidates(chunks: DataFrame, at_least: float = 0.85, k: int | None = None) -> DataFrame:
    """Similar chunks above the limit from other documents of the same collection, or the best ``k``.

    ``chunks`` holds collection, document_id, id, vector. Exact copies collapse first: copies
    spread over documents appear as a pair of the chunk with itself.
    """
    one = vectors.distinct_vectors(chunks, ["collection"], "document_id")
    columns = ["collection", "id", "vector", "first_document", "last_document"]

    def other(left: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
        """Not both wholly from one and the same document."""
        whole = (left["first_document"] == left["last_document"]).to_numpy()
        single = (rows["first_document"] == rows["last_document"]).to_numpy()
        same = left["first_document"].to_numpy()[:, None] == rows["first_document"].to_numpy()[None, :]
        return ~(same & whole[:, None] & single[None, :])

    found = vectors.best_partners(
        one.select(*columns), one.select(*columns), ["collection"], k, at_least, other
    )
    return found.select(
        "collection", F.col("right_id").alias("chunk_id"), F.col("left_id").alias("similar_id"), "score",
    )
