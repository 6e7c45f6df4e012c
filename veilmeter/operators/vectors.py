"""Exact nearest neighbours by cosine, as block-wise joins.

Both sides are cut into blocks per match group (tenant, collection), as many as the group's size
asks for, and every left block meets every right block once. A task multiplies two blocks and
keeps, for each right row, only its best partners, so the pairs of a group are never emitted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 20_000


def _blocks(df: DataFrame, keys: list[str], rows: int, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))


def _matrix(column: pd.Series) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(norm == 0, 1.0, norm)[:, None]


def _meeting(allowed, k: int | None, at_least: float | None, keys: list[str]):
    """Function joining one left block with one right block.

    A matrix product finds the candidates with a margin for its rounding; only those are scored
    again row by row, which gives the same digits wherever a row lies in its block.
    """
    margin, step, few = 1e-6, 256, 64

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "right_id", "left_id", "score"]
        if left.empty or right.empty:
            return pd.DataFrame({n: [] for n in names})
        a, b = _matrix(left["vector"]), _matrix(right["vector"])
        left_ids, right_ids = left["id"].to_numpy(), right["id"].to_numpy()
        lefts, rights, scores = [], [], []
        for start in range(0, len(b), step):
            part = slice(start, start + step)
            rough = a @ b[part].T
            near = None if at_least is None else rough >= at_least - margin
            if near is not None and np.count_nonzero(near) <= few * rough.shape[1]:
                # Few reach the limit: only these are looked at further.
                at, row = np.nonzero(near)
                if allowed is not None and len(at):
                    fits = allowed(left, right.iloc[part])[at, row]
                    at, row = at[fits], row[fits]
            else:
                if allowed is not None:
                    rough[~allowed(left, right.iloc[part])] = -np.inf
                floor = np.full(rough.shape[1], -2.0 if at_least is None else at_least - margin)
                if k is not None and len(a) > k:
                    # The k-th best of every right row at once; what is not allowed ranks last.
                    floor = np.maximum(floor, np.partition(rough, len(a) - k, axis=0)[len(a) - k] - margin)
                at, row = np.nonzero(rough >= floor)
            score = np.round(np.einsum("ij,ij->i", a[at], b[part][row]), 9)
            if at_least is not None:
                good = score >= at_least
                at, row, score = at[good], row[good], score[good]
            order = np.lexsort((left_ids[at], -score, row))
            at, row, score = at[order], row[order], score[order]
            if k is not None:
                first = np.searchsorted(row, row)
                best = np.arange(len(row)) - first < k
                at, row, score = at[best], row[best], score[best]
            lefts.append(left_ids[at])
            rights.append(right_ids[part][row])
            scores.append(score)
        out = pd.DataFrame(
            {"right_id": np.concatenate(rights), "left_id": np.concatenate(lefts), "score": np.concatenate(scores)}
        )
        for name in keys:
            out[name] = left[name].iloc[0]
        return out[names]

    return join


def best_partners(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    k: int | None,
    at_least: float | None = None,
    allowed=None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each right row its ``k`` best left rows of the same ``keys`` by cosine, with rank.

    Without ``k`` every left row of at least the limit is a partner and no rank is added.

    Both sides hold ``keys``, ``id``, ``vector`` and whatever ``allowed(left_block, right_rows)``
    reads to say which pairs count, as a matrix of a row for each left row. Ties go to the smaller id. Scores are rounded to nine digits.
    """
    keys = list(keys)
    # Fresh column identities, because both sides may be the same table.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    n_left, n_right = _blocks(left, keys, block_rows, "_nl"), _blocks(right, keys, block_rows, "_nr")
    sizes = n_left.join(n_right, keys)

    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    a = left.join(sizes, keys).withColumn("_i", own("_nl")).withColumn("_j", every("_nr"))
    b = right.join(sizes, keys).withColumn("_j", own("_nr")).withColumn("_i", every("_nl"))
    types = ", ".join(f"{c} {left.schema[c].dataType.simpleString()}" for c in keys)
    id_type = left.schema["id"].dataType.simpleString()
    schema = f"{types}, right_id {right.schema['id'].dataType.simpleString()}, left_id {id_type}, score double"
    block = [*keys, "_i", "_j"]
    pairs = (
        a.drop("_nl", "_nr").groupBy(*block)
        .cogroup(b.drop("_nl", "_nr").groupBy(*block))
        .applyInPandas(_meeting(allowed, k, at_least, keys), schema)
    )
    if k is None:
        return pairs
    # At most k rows per right row and left block arrive here.
    w = Window.partitionBy(*keys, "right_id").orderBy(F.col("score").desc(), "left_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def distinct_vectors(df: DataFrame, keys: Sequence[str], document: str) -> DataFrame:
    """Collapse exact copies: the smallest id stands for all, with its copies' document range."""
    return df.groupBy(*keys, "vector").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"),
        F.min(document).alias("first_document"), F.max(document).alias("last_document"),
    )
