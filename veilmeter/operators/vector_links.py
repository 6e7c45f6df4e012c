"""Groups of similar vectors by banded random hyperplanes.

The side of a random hyperplane on which a vector lies is one bit; two vectors at angle t agree in it
with probability 1 - t / pi. ``BITS`` such bits make a band's key, and vectors that share the key of any
of ``BANDS`` bands meet and are compared exactly. Of a group that meets only its inner connection
leaves the task, a row for each vector at most, so a thousand copies make a thousand rows and not a
million pairs.

A pair of cosine c is missed with probability (1 - (1 - acos(c) / pi) ** BITS) ** BANDS: 0.0015 at 0.85,
below 1e-6 from 0.93. The hyperplanes are fixed, so a run repeats exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames.components import components
from ..session import durable
from .vectors import _matrix

BANDS, BITS = 64, 12
#: Rows of a bucket compared in one task; a fuller bucket is cut into such parts, and all parts meet.
MOST = 2048
#: Rows of small buckets taken together.
SLOT_ROWS = 20_000


def miss_rate(cosine: float, bands: int = BANDS, bits: int = BITS) -> float:
    """Probability that a pair of this cosine shares no band."""
    return float((1 - (1 - np.arccos(cosine) / np.pi) ** bits) ** bands)


def _keys(bands: int, bits: int, seed: int = 20240101):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes, step = None, 512
        for batch in batches:
            for first in range(0, len(batch), step):
                rows = batch.iloc[first : first + step]
                x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
                if planes is None or len(planes) != x.shape[1]:
                    planes = np.random.default_rng(seed).standard_normal((x.shape[1], bands * bits))
                sides = ((x @ planes) >= 0).reshape(len(x), bands, bits)
                key = sides @ (1 << np.arange(bits, dtype=np.int64))
                out = rows.loc[rows.index.repeat(bands)]
                yield out.assign(band=np.tile(np.arange(bands, dtype=np.int32), len(rows)), key=key.ravel())

    return run


def _joined(near: np.ndarray) -> np.ndarray:
    """Least member of each row's component."""
    label = np.arange(len(near))
    while True:
        beside = np.where(near, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, beside)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def by_bucket(each, columns: Sequence[str], out: Sequence[str]):
    """Function for a group of ``meetings``: ``each`` gets the ``columns`` of one bucket, by id, and its unit vectors."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["band", "key", "id"], kind="stable")
        x, values = _matrix(rows["vector"]), [rows[c].to_numpy() for c in columns]
        band, key = rows["band"].to_numpy(), rows["key"].to_numpy()
        begins = np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (key[1:] != key[:-1])))
        ends = np.append(begins[1:], len(rows))
        found = [each(*[v[i:j] for v in values], x[i:j]) for i, j in zip(begins.tolist(), ends.tolist(), strict=True) if j - i > 1]
        return pd.DataFrame({c: np.concatenate([f[k] for f in found]) if found else [] for k, c in enumerate(out)})

    return run


def _connected(at_least: float):
    """Rows that are linked, each with the least id of its component among those that met."""

    def each(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        product = x @ x.T
        near = product >= at_least - 1e-6
        # What rounding could decide is scored again, row by row.
        for i, j in np.argwhere(np.triu(near & (product < at_least + 1e-6), 1)):
            near[i, j] = near[j, i] = round(float(np.einsum("i,i->", x[i], x[j])), 9) >= at_least
        np.fill_diagonal(near, True)
        label = _joined(near)
        moved = label != np.arange(len(label))
        return ids[moved], ids[label[moved]]

    return each


def meetings(rows: DataFrame, group: str, bands: int = BANDS, bits: int = BITS, most: int = MOST):
    """``rows`` (``group``, id, vector and more; written, as they are counted first) dealt out so that two rows of
    a group that share a band's key meet in a task: grouped, for ``applyInPandas(by_bucket(...))``. A fuller
    bucket is cut into parts, and every two parts meet."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    keyed = rows.mapInPandas(_keys(bands, bits), f"{schema}, band int, key bigint")
    bucket = [group, "band", "key"]
    # Only full buckets are looked up, one in most / 2 rows at most; so the vectors are shuffled once, to where they meet.
    sizes = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most / 2)
    cut = sizes.select(*bucket, F.ceil(F.col("n") / (most / 2)).cast("int").alias("parts"))
    dealt = keyed.join(F.broadcast(cut), bucket, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    met = dealt.select("*", other).select(
        "*", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
    ).drop("parts", "part", "other")
    # A task takes many small buckets at once.
    slots = max(1, rows.count() * bands // SLOT_ROWS)
    met = met.withColumn("slot", F.pmod(F.xxhash64(*bucket), F.lit(slots)))
    return met.groupBy(group, "slot", "low", "high")


def similar_groups(vectors: DataFrame, at_least: float = 0.85, bands: int = BANDS, bits: int = BITS, most: int = MOST) -> DataFrame:
    """(collection, id, component, members) of every row of ``vectors`` (collection, id, vector).

    Rows of a collection are linked where their cosine, rounded to nine digits, reaches ``at_least``; the
    component is the smallest id reachable, its own where nothing is linked. Exact copies are one
    vector. Rows without a vector or collection stay alone. Ids are unique over all collections.
    """
    rows = durable(vectors.select("collection", "id", "vector"))
    one = rows.where("vector IS NOT NULL").groupBy("collection", "vector").agg(F.min("id").alias("id"))
    one = durable(one)
    kind = one.schema["id"].dataType.simpleString()
    met = meetings(one.where("collection IS NOT NULL"), "collection", bands, bits, most)
    links = durable(met.applyInPandas(by_bucket(_connected(at_least), ["id"], ["a", "b"]), f"a {kind}, b {kind}").distinct())
    found = components(links)
    of_vector = one.join(found, "id", "left").select("collection", "vector", F.coalesce("component", "id").alias("component"))
    grouped = rows.join(of_vector, ["collection", "vector"], "left").select("collection", "id", F.coalesce("component", "id").alias("component"))
    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    return grouped.join(sizes, "component").select("collection", "id", "component", "members")
