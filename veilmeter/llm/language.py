"""Language of texts by the nearest centroid of character n-grams (operator 10).

A text's vector holds the counts of its letter runs' 1-, 2- and 3-grams (a blank at either end of a
run), hashed to ``FEATURES`` places, damped as 1 + ln(count), weighted by inverse document frequency
and scaled to length one. Each language's sample is clustered into ``CLUSTERS`` centroids by spherical
k-means. A text takes the language of the centroid of highest cosine; it counts as rejected if that
cosine is below the least one among the centroid's own texts, less ``SLACK``.

Fitted on a bounded sample: ``SAMPLE`` different texts for each language, those of the least hashes
of the text, equal texts once.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import own, written

FEATURES = 4096
SAMPLE = 500
CLUSTERS, ROUNDS = 4, 12
SLACK = 0.05
_PIECE = 1 << 19  # code points looked at in one go
_ROWS = 256


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def _is_letter(codes: np.ndarray) -> np.ndarray:
    found = _letters()[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        found[high] = [chr(c).isalpha() for c in codes[high]]
    return found


def _hashed(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)


def counts(text: str | None) -> np.ndarray | None:
    """N-gram counts, or None if the text is missing or has no letter."""
    if not text:
        return None
    total, any_letter = np.zeros(FEATURES, np.int64), False
    tail = np.array([32], np.uint64)
    for at in range(0, len(text), _PIECE):
        codes = np.frombuffer(text[at : at + _PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _is_letter(codes)
        any_letter = any_letter or bool(letter.any())
        codes = np.where(letter, codes, 32).astype(np.uint64)
        c, seen = np.concatenate([tail, codes]), len(tail)
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        if at + _PIECE >= len(text) and c[-1] != 32:
            c = np.append(c, np.uint64(32))
        # Grams that end behind what earlier pieces have counted.
        pair = c[:-1] * np.uint64(0x110000) + c[1:]
        triple = pair[:-1] * np.uint64(0x1F3D5B79) + c[2:] + np.uint64(1 << 50)
        grams = [c[seen:] + np.uint64(1), pair[seen - 1 :] + np.uint64(1 << 42), triple[max(seen - 2, 0) :]]
        total += np.bincount(_hashed(np.concatenate(grams)), minlength=FEATURES)
        tail = c[-2:]
    return total if any_letter else None


def vectors(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    raw = np.stack(rows).astype(np.float32)
    np.log(raw, out=raw, where=raw > 0)
    x = np.where(np.stack(rows) > 0, (1 + raw) * idf, 0).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centroids(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first starts; centroids and their members' least cosine."""
    start = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[start[0]]
    while len(start) < min(CLUSTERS, len(x)) and near.min() < 0.999:
        start.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start]
    for _ in range(ROUNDS):
        member = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[member == k].sum(axis=0) if (member == k).any() else c[k] for k in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    cosine = x @ c.T
    member = np.argmax(cosine, axis=1)
    least = [cosine[member == k, k].min() if (member == k).any() else 1.0 for k in range(len(c))]
    return c, np.array(least)


def _sparse(batches):
    for batch in batches:
        langs, places, values = [], [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if (n := counts(text)) is not None:
                at = np.flatnonzero(n)
                langs.append(lang)
                places.append(at.tolist())
                values.append(n[at].tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64()))],
            names=["lang", "places", "counts"],
        )


def held_out(doc_id) -> F.Column:
    """Rows no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame) -> dict:
    """Centroids from (text, lang); what is collected is bounded by FEATURES and languages."""
    digest = F.xxhash64("text")
    rows = own(labelled, "text", "lang").where("text is not null and lang is not null").withColumn("h", digest)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = rows.select("lang", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= SAMPLE)
    sample = rows.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    sample = written(
        sample.select("lang", "text").mapInArrow(_sparse, "lang string, places array<int>, counts array<bigint>"), batch_rows=500
    )
    n = sample.count()
    seen = sample.select(F.explode("places").alias("place")).groupBy("place").count().toPandas()  # FEATURES rows at most
    idf = np.full(FEATURES, np.log(n + 1.0) + 1, np.float32)
    idf[seen["place"].to_numpy(np.int64)] = np.log((n + 1.0) / (seen["count"].to_numpy(float) + 1)) + 1

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        # SAMPLE rows at most, in an order that doesn't depend on the shuffle.
        dense = []
        for at, value in sorted(zip(map(tuple, group["places"]), map(tuple, group["counts"]), strict=True)):
            row = np.zeros(FEATURES, np.int64)
            row[list(at)] = value
            dense.append(row)
        c, least = centroids(vectors(dense, idf))
        return pd.DataFrame(
            {"lang": group["lang"].iloc[0], "cluster": range(len(c)), "centre": [x.tolist() for x in c], "least": least}
        )

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, cluster int, centre array<float>, least double")
    found = found.toPandas().sort_values(["lang", "cluster"], kind="stable")
    centre = np.array(found["centre"].tolist(), np.float32).reshape(-1, FEATURES)
    return {"idf": idf, "langs": found["lang"].tolist(), "centre": centre, "least": found["least"].to_numpy(float)}


def _predict(sent):
    def run(batches):
        model = sent.value
        for batch in batches:
            n = batch.num_rows
            lang, score, rejected = ["und"] * n, np.zeros(n), np.ones(n, bool)
            texts = batch.column("text")
            for first in range(0, n if model["langs"] else 0, _ROWS):
                at, rows = [], []
                for i in range(first, min(first + _ROWS, n)):
                    if (c := counts(texts[i].as_py())) is not None:
                        at.append(i)
                        rows.append(c)
                if rows:
                    cosine = vectors(rows, model["idf"]) @ model["centre"].T
                    best = np.argmax(cosine, axis=1)
                    for i, k, value in zip(at, best, cosine[np.arange(len(rows)), best], strict=True):
                        lang[i] = model["langs"][k]
                        score[i] = min(max(float(value), 0.0), 1.0)
                        rejected[i] = value < model["least"][k] - SLACK
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score), pa.array(rejected)],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return run


def languages(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, rejected.

    Learns from text and non-null lang of the rows not held out; a prediction sees the text alone.
    lang_pred is ``und`` with score 0 if the text is null or has no letter, or if nothing could be
    learned. A rejected text keeps its nearest language. Of equal cosines the first language by name
    wins. Rows with a null doc_id are predicted and not learned from; repeated rows are predicted
    alike; other columns are ignored.
    """
    rows = own(docs, "doc_id", "text", "lang")
    model = fit(rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    asked = rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    kind = asked.schema["doc_id"].dataType.simpleString()
    return asked.mapInArrow(
        _predict(sent), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean"
    )
