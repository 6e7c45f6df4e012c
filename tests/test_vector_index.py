"""The stored index against brute force, and groups of similar vectors against all pairs."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmeter.operators import retrieval, vector_index as I, vector_links as L
from veilmeter.plans import retrieval as queries

CHUNKS = "tenant_id string, id bigint, vector array<float>, acl_groups array<string>, quarantined boolean"
ASKED = "tenant_id string, id bigint, vector array<float>, groups array<string>"


def rows(n, seed=1, spread=0.35, dims=16, centres=40):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dims))
    x = middle[rng.integers(centres, size=n)] + spread * rng.standard_normal((n, dims))
    groups = [["a"], ["b"], ["a", "c"], []]
    return [(["t1", "t2"][i % 5 == 0], i, x[i].astype(np.float32).tolist(), groups[i % 4], i % 13 == 0) for i in range(n)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / uuid.uuid4().hex)
    extra = [("t1", 9000, None, ["a"], False), ("t3", 9001, [0.0] * 16, ["a"], False)]
    I.build(spark.createDataFrame(rows(6000) + extra, CHUNKS), path, cells=64)
    asked = [(t, 10 * i + k, r[2], ["a", "c"]) for i, r in enumerate(rows(30, 2)) for k, t in enumerate(("t1", "t2", "t9"))]
    return path, spark.createDataFrame(asked + [("t1", 999, None, ["a"])], ASKED)


def test_every_cell_is_exact_and_few_cells_reach_nine_tenths(spark, index):
    path, asked = index
    chunks = spark.createDataFrame(rows(6000), CHUNKS)
    want = retrieval.vector_branch(chunks, asked.where("vector IS NOT NULL"), 20).collect()
    got = I.search(spark, path, asked, 20, probes=None).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 60 * 20
    near = I.search(spark, path, asked, 20, probes=8, reach=8)
    r = I.recall(near, I.search(spark, path, asked, 20, probes=None)).first()
    assert (r.queries, r.wanted) == (60, 1200) and 0.9 <= r.recall <= 1
    cells = I.probed(spark, path, asked.where("vector IS NOT NULL"), 20, 8, 8).where("tenant_id = 't1'").groupBy("id").count().agg(F.max("count")).first()[0]
    assert cells <= 24  # of 64


def test_only_the_asked_cells_are_listed(spark, index):
    path, asked = index
    plan = I.search(spark, path, asked.where("id = 0 AND tenant_id = 't1'"), 5, probes=1, reach=1)._jdf.queryExecution().executedPlan().toString()
    assert "cell#" in plan.split("PartitionFilters")[1][:80]


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "empty")
    I.build(spark.createDataFrame([], CHUNKS), path)
    asked = spark.createDataFrame([("t", 1, [1.0, 0.0], ["a"])], ASKED)
    assert I.search(spark, path, asked).count() == 0


def test_recall_of_the_registered_index(spark):
    r = queries.index_recall(spark, "/root/testdata/sf0.01").first()
    assert r.recall >= 0.9 and r.wanted == r.queries * 40


def components(links, ids):
    label = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("most", [2048, 40])
def test_groups_equal_all_pairs(spark, most):
    data = [(i % 3, r[1], r[2]) for i, r in enumerate(rows(500, 3, spread=0.3))]
    data += [(0, 5000 + i, data[0][2]) for i in range(300)]  # copies
    near = np.array(data[3][2])
    data += [(0, 6000 + i, (near + 0.02 * np.sin(np.arange(16) + i)).tolist()) for i in range(150)]  # a crowded bucket
    data += [(1, 7000, None), (None, 7001, data[1][2]), (1, 7002, [0.0] * 16)]
    df = spark.createDataFrame(data, "collection int, id bigint, vector array<float>")
    got = {r.id: (r.component, r.members) for r in L.similar_groups(df, most=most).collect()}
    have = [d for d in data if d[2] is not None and d[0] is not None]
    x = np.array([d[2] for d in have], np.float32).astype(float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    near = (np.round(x @ x.T, 9) >= 0.85) & (np.array([d[0] for d in have])[:, None] == np.array([d[0] for d in have])[None])
    label = components([(have[i][1], have[j][1]) for i, j in np.argwhere(np.triu(near, 1))], [d[1] for d in data])
    sizes = {c: sum(v == c for v in label.values()) for c in label.values()}
    assert {i: c for i, (c, _) in got.items()} == label
    assert all(m == sizes[c] for c, m in got.values())


def test_miss_rate():
    assert L.miss_rate(0.85) < 0.0016 and L.miss_rate(0.93) < 1e-6
