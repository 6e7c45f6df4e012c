import numpy as np
import pytest
from edge import clashing, documents

from veilmeter.llm import mixing as mx
from veilmeter.llm.mixing import DOMAINS, TARGETS, domains, fit, memberships, mixed, rates, solve

LABELS = "doc_id long, quality int, toxic int"


def frame(spark, p, tokens):
    rows = [(i, int(t), *map(float, x)) for i, (t, x) in enumerate(zip(tokens, p, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS))


@pytest.mark.parametrize("most", [None, 1.0])
@pytest.mark.parametrize("seed", [0, 1])
def test_rates_meet_targets(spark, seed, most):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.6, 0.2, 0.3], 300)
    tokens = rng.integers(0, 500, 300)
    members = frame(spark, p, tokens)
    share = np.array([TARGETS[d] for d in DOMAINS])
    target = share * (p[:, 0] * tokens).sum() / share[0]
    solved = solve(members, most=most)
    got = np.array([r.rate for r in members.withColumn("rate", mx._rate(solved["steps"], most)).orderBy("doc_id").collect()])
    assert (got >= 0).all() and (most is None or (got <= most).all())
    reached = (p * (tokens * got)[:, None]).sum(axis=0)
    assert np.allclose(reached, solved["expected"])
    natural = (p * tokens[:, None]).sum(axis=0)
    if most is None:
        assert np.allclose(reached, target, rtol=1e-4)
    else:  # out of reach without repeats, yet nearer than the natural mix
        assert np.abs(reached - target).max() < 0.5 * np.abs(natural - target).max()


def exact(p, tokens, target, most):
    """Bounded least squares over the documents, by plain coordinate descent."""
    a, r = p * tokens[:, None], np.ones(len(p))
    gap = a.sum(axis=0) - target
    for _ in range(3000):
        for i in range(len(p)):
            if tokens[i]:
                new = min(most, max(0.0, r[i] - a[i] @ gap / (a[i] @ a[i])))
                gap, r[i] = gap + (new - r[i]) * a[i], new
    return gap + target


@pytest.mark.parametrize("soft", [0.0, 0.02])
@pytest.mark.parametrize("toxic", [5, 11])
def test_a_scarce_domain_keeps_no_other_from_its_target(spark, toxic, soft):
    """Hardly any poor document: its gap is fixed, and the largest one if toxic ones are few."""
    n = 100
    hard = np.zeros((n, 3))
    hard[:toxic, 2] = hard[toxic + 1 :, 0] = hard[toxic, 1] = 1
    p = (1 - soft) * hard + soft * np.random.default_rng(toxic).dirichlet([1, 1, 1], n)
    tokens = np.full(n, 100)
    tokens[toxic] = 1
    target = np.array([0.9, 0.08, 0.02]) * (p[:, 0] * tokens).sum() / 0.9
    found = solve(frame(spark, p, tokens), most=1.0)
    assert np.allclose(found["expected"], exact(p, tokens, target, 1.0), atol=2e-4 * target.sum())
    got = np.array([r.rate for r in frame(spark, p, tokens).withColumn("rate", mx._rate(found["steps"], 1.0)).orderBy("doc_id").collect()])
    assert (got[toxic + 1 :] == 1).all() and got[toxic] == 1
    assert abs(found["expected"][2] / found["target"][2] - 1) < (0.05 if soft else 1e-4)


def test_targets_and_bounds(spark):
    p = np.array([[0.9, 0.1, 0.0], [0.2, 0.8, 0.0], [0.5, 0.5, 0.0]])
    solved = solve(frame(spark, p, [10, 20, 30]))  # no toxic membership: out of reach, ends, and says so
    assert 0 < solved["residual"] <= 0.03
    with pytest.raises(ValueError):
        solve(frame(spark, p, [1, 1, 1]), {"good": 1.0})
    with pytest.raises(ValueError):
        solve(frame(spark, p, [1, 1, 1]), {"good": -1.0, "poor": 1, "toxic": 1})


def test_classifier_on_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    judged = memberships(docs.select("doc_id", "text"), fit(docs, labels)).join(domains(labels), "doc_id").collect()
    right = sum(max(DOMAINS, key=lambda d: r[f"p_{d}"]) == r.domain for r in judged)
    assert right > 0.94 * len(judged)
    assert all(abs(sum(r[f"p_{d}"] for d in DOMAINS) - 1) < 1e-9 for r in judged)


def test_domains(spark):
    rows = [(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, None), (5, None, 1), (6, 0, None), (7, 1, 0), (7, 0, 0), (None, 1, 0)]
    got = {r.doc_id: r.domain for r in domains(spark.createDataFrame(rows, LABELS)).collect()}
    assert got == {1: "good", 2: "poor", 3: "toxic", 5: "toxic", 6: "poor", 7: "poor"}


def test_edge_rows(spark):
    docs = clashing(documents(spark))
    labels = clashing(spark.createDataFrame([(4, 1, 0), (6, 0, 0), (7, 1, 1), (8, None, None)], LABELS))
    rows = rates(docs, labels).collect()
    assert len(rows) == 12 and all(r.rate >= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {0}
    out = mixed(docs, labels, most=1.0)
    assert out.columns == docs.columns and out.count() <= 12
    none = spark.createDataFrame([], LABELS)
    assert all(abs(r.p_good - 1 / 3) < 1e-9 for r in rates(docs, none).collect())
    assert rates(documents(spark, []), labels).count() == 0


def test_mixed_repeats_by_rate(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(2000)], "doc_id long, text string")
    none = spark.createDataFrame([], LABELS)
    total = 2000 * 3
    out = mixed(docs, none, {"good": 1, "poor": 1, "toxic": 1}, budget=2.5 * total).groupBy("doc_id").count().collect()
    assert {r["count"] for r in out} == {2, 3} and len(out) == 2000
    assert abs(sum(r["count"] for r in out) - 5000) < 150
