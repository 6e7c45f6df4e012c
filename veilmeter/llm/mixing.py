"""Rates for documents so that a mix of domains meets target weights (operator 6).

1. A naive Bayes classifier learns from the labelled table: the presence of ``WORDS`` selected words
   and binned text statistics. It gives every document soft memberships of the domains. It is fitted
   on a bounded sample, the ``SAMPLE`` labelled documents with the least hashes of doc_id.
2. Rates r in [0, most], one for each document, minimise the squared distance of the expected
   domain tokens ``E = sum(tokens * membership * rate)`` from the targets, by one projected gradient
   step from r = 1 whose gradient is taken where it ends:

       r = clip(1 - membership . y),   y = (E(r) - target) / m

   That is the exact minimum of the squared distance plus m times the squared, token-weighted change
   of the rates, so as m falls to ``LAST`` it becomes the bounded least squares' own; a domain out of
   reach keeps its distance and does not keep the others from their targets. y, K numbers, is the
   minimum of a smooth convex function (the dual), found by Newton steps with the memberships'
   moments over the documents whose rate is free to move; a few step lengths are tried at once.
   A step needs K domain sums, the moments and the function's value: one aggregate over the written
   memberships. A document's rate follows from y, so nothing else leaves the executors.

All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import CAPITALS, MARKS, SPACES, count_of
from .shared import one_row, own, written

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}
SAMPLE, WORDS, LEAST_SEEN = 8000, 200, 5
STEPS, CLOSE = 30, 1e-6
FIRST, LAST, SHRINK, LENGTHS = 1e-2, 1e-9, 0.03, (1.0, 0.4, 0.1)
_PUNCTUATION = ".,;:!?\"'()[]"


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic, else good or poor by quality; without either label none.

    Of several labels of a document the strictest counts.
    """
    rows = own(labels, "doc_id", "quality", "toxic").where("doc_id is not null")
    one = rows.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    domain = F.when(F.col("t") == 1, "toxic").when(F.col("q") == 1, "good").when(F.col("q") == 0, "poor")
    return one.select("doc_id", domain.alias("domain")).where("domain is not null")


def _statistics(text: Column, words: Column) -> list[Column]:
    """Binned statistics as words no text contains."""

    def level(name: str, value: Column, *bounds: float) -> Column:
        rank = sum(((value >= b).cast("int") for b in bounds), F.lit(0))
        return F.concat(F.lit(f" {name}"), rank.cast("string"))

    length, n = F.greatest(F.length(text), F.lit(1)), F.greatest(F.size(words), F.lit(1))
    return [
        level("symbols", count_of(text, MARKS) / length, 0.001, 0.02, 0.08),
        level("capitals", F.regexp_count(text, F.lit(CAPITALS)) / length, 0.05, 0.15, 0.33),
        level("distinct", F.size(F.array_distinct(words)) / n, 0.2, 0.35, 0.5),
        level("words", n, 10, 40, 200),
    ]


def _featured(docs: DataFrame) -> DataFrame:
    """Add words (lower case, without punctuation), their number and statistics; a null text counts
    as empty."""
    text = F.coalesce("text", F.lit(""))
    apart = _PUNCTUATION + SPACES
    low = F.translate(F.lower(text), apart, " " * len(apart))
    rows = one_row(docs, t=text, words=F.array_remove(F.split(low, " "), ""))
    extra = F.array(*_statistics(F.col("t"), F.col("words")))
    return one_row(rows, n_tokens=F.size("words").cast("bigint"), extra=extra)


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Selected words with their log odds for each domain; at most ``WORDS`` rows are collected."""
    chosen = written(domains(labels).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(SAMPLE).drop("h"))
    seen = own(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    seen = _featured(seen).select("domain", F.array_distinct(F.concat("words", "extra")).alias("present"))
    seen = written(seen)
    sizes = {r["domain"]: r["count"] for r in seen.groupBy("domain").count().collect()}
    total = np.array([sizes.get(d, 0) for d in DOMAINS], float)
    held = [F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS]
    table = seen.select("domain", F.explode("present").alias("word")).groupBy("word").agg(*held)
    n = max(total.sum(), 1.0)
    every = sum((F.col(d) for d in DOMAINS[1:]), F.col(DOMAINS[0]))
    # Chi-square of a word's presence against the domains.
    expected = {d: every * float(total[i] / n) for i, d in enumerate(DOMAINS)}
    chi = sum(
        ((F.col(d) - expected[d]) * (F.col(d) - expected[d]) / expected[d] for i, d in enumerate(DOMAINS) if total[i]),
        F.lit(0.0),
    )
    top = table.where((every >= LEAST_SEEN) & (every < float(n))).orderBy(chi.desc(), "word").limit(WORDS).collect()
    counts = np.array([[r[d] for d in DOMAINS] for r in top], float).reshape(-1, len(DOMAINS))
    p = (counts + 1) / (total + 2)
    prior = np.log((total + 1) / (n + len(DOMAINS)))
    return {
        "words": [r["word"] for r in top],
        "weights": np.log(p) - np.log1p(-p),
        "base": prior + np.log1p(-p).sum(axis=0),
    }


def memberships(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with n_tokens and p_<domain>, which add up to one; the input's columns stay."""
    rows = _featured(docs)
    known = F.array(*map(F.lit, model["words"])) if model["words"] else F.array().cast("array<string>")
    rows = one_row(rows, found=F.array_intersect(F.concat("words", "extra"), known))
    places = F.transform("found", lambda w: F.array_position(known, w).cast("int") - 1)
    rows = one_row(rows, places=places)

    def logit(i: int) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in model["weights"][:, i]]) if model["words"] else None
        if weights is None:
            return F.lit(float(model["base"][i]))
        return F.aggregate("places", F.lit(float(model["base"][i])), lambda a, k: a + F.get(weights, k))

    rows = one_row(rows, **{f"_l{i}": logit(i) for i in range(len(DOMAINS))})
    names = [f"_l{i}" for i in range(len(DOMAINS))]
    rows = one_row(rows, _top=F.greatest(*names))
    rows = one_row(rows, **{f"_e{i}": F.exp(F.col(c) - F.col("_top")) for i, c in enumerate(names)})
    whole = sum((F.col(f"_e{i}") for i in range(1, len(DOMAINS))), F.col("_e0"))
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "n_tokens",
        *[(F.col(f"_e{i}") / whole).alias(f"p_{d}") for i, d in enumerate(DOMAINS)],
    )


def _rate(steps: list[np.ndarray], most: float | None, floor: bool = True) -> Column:
    """Rate of a document after the given steps, at least 0 (if ``floor``) and at most ``most``."""
    rate = F.lit(1.0)
    for step in steps:
        move = sum((F.col(f"p_{d}") * float(step[i]) for i, d in enumerate(DOMAINS) if i), F.col(f"p_{DOMAINS[0]}") * float(step[0]))
        rate = F.greatest(F.lit(0.0), rate - move) if floor else rate - move
        rate = rate if most is None else F.least(F.lit(float(most)), rate)
    return rate


def solve(
    members: DataFrame, targets: Mapping[str, float] = TARGETS, budget: float | None = None, most: float | None = None
) -> dict:
    """The projected gradient step over written memberships, with the residual it reaches.

    ``budget`` is the wanted number of tokens; by default the domain of the largest weight stays
    whole. ``most`` bounds the rates, e.g. 1 to repeat no document. What cannot be reached, for that
    bound or for want of memberships, shows in the residual, a share of the budget.
    """
    if set(targets) != set(DOMAINS) or min(targets.values()) < 0 or not sum(targets.values()) > 0:
        raise ValueError("every domain needs a weight of at least 0, one more than 0")
    share = np.array([targets[d] for d in DOMAINS], float) / sum(targets.values())
    k = len(DOMAINS)
    p = [F.col(f"p_{d}") for d in DOMAINS]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    tokens = F.col("n_tokens").cast("double")

    def sums(steps: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """For each step: expected domain tokens, moments of the free documents, and the sum of the
        antiderivative of the rate."""
        rows = own(members, "n_tokens", *[f"p_{d}" for d in DOMAINS])
        bare = {f"_z{j}": _rate([y], None, floor=False) for j, y in enumerate(steps)}
        rows = one_row(rows, **bare)
        wanted = []
        for z in map(F.col, bare):
            rate = F.greatest(F.lit(0.0), z) if most is None else F.least(F.lit(float(most)), F.greatest(F.lit(0.0), z))
            free = z > 0 if most is None else (z > 0) & (z < float(most))
            # Half the square inside, straight beyond the bound.
            value = rate * (z - rate / 2)
            wanted += [F.sum(tokens * x * rate) for x in p]
            wanted += [F.sum(F.when(free, tokens * p[i] * p[j])) for i, j in pairs]
            wanted += [F.sum(tokens * value)]
        found = np.array([float(v or 0.0) for v in rows.agg(*wanted).collect()[0]]).reshape(len(steps), -1)
        out = []
        for row in found:
            g = np.zeros((k, k))
            for v, (i, j) in zip(row[k:], pairs, strict=False):
                g[i, j] = g[j, i] = v
            out.append((row[:k], g, float(row[-1])))
        return out

    y = np.zeros(k)
    expected, g, value = sums([y])[0]
    if budget is None:
        lead = int(np.argmax(share))
        budget = expected[lead] / share[lead]
    target, scale = share * budget, max(budget, 1.0)
    gap = lambda x: float(np.abs(x - target).max() / scale)
    m = FIRST * scale
    if most is not None and most <= 1:  # at r = 1 no document is inside the bounds, yet all may come down
        g = sums([np.full(k, 1 - most / 2)])[0][1]
    while gap(expected) > CLOSE:
        for _ in range(STEPS):
            slope = m * y - (expected - target)
            if np.abs(slope).max() <= CLOSE / 10 * scale:
                break
            step = np.linalg.solve(m * np.eye(k) + g, -slope)
            level = m / 2 * y @ y + y @ target + value
            better = None
            for shorter in (1.0, 0.02, 4e-4):
                tried = [y + shorter * a * step for a in LENGTHS]
                found = sums(tried)
                levels = [m / 2 * x @ x + x @ target + f[2] for x, f in zip(tried, found, strict=True)]
                best = int(np.argmin(levels))
                after = np.linalg.norm(m * tried[best] - (found[best][0] - target))
                if levels[best] < level or after < np.linalg.norm(slope):
                    better = tried[best], *found[best]
                    break
            if better is None:
                break  # no further in double precision
            y, expected, g, value = better
        if m <= LAST * scale:
            break  # what is left is out of reach
        m = max(m * SHRINK, LAST * scale)
    return {"steps": [y], "target": target, "expected": expected, "residual": gap(expected)}


def rates(
    docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS,
    budget: float | None = None, most: float | None = None,
) -> DataFrame:
    """Per row: doc_id, n_tokens, p_<domain>, rate.

    Rows with null doc_ids and repeated rows get rates like any other; null and empty texts have no
    tokens, and their memberships follow from the prior and the statistics of an empty text. Without
    labels all memberships are equal. Other columns are ignored.
    """
    model = fit(docs, labels)
    members = written(memberships(own(docs, "doc_id", "text"), model).drop("text"))
    return members.withColumn("rate", _rate(solve(members, targets, budget, most)["steps"], most))


def mixed(
    docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS,
    budget: float | None = None, most: float | None = None,
) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says.

    The whole part of a rate is taken in full; of the fraction every document (by the hash of doc_id
    and text) is taken or not, so that equal rows are treated alike.
    """
    model = fit(docs, labels)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    members = written(memberships(packed, model))
    rate = _rate(solve(members, targets, budget, most)["steps"], most)
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")
    return (
        members.select("_row", times.alias("_times"))
        .where("_times > 0")
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .select("_row.*")
    )
