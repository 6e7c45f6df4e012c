import os
import subprocess
import sys

import corpus_pipeline as cp
from edge import clashing, documents
from test_decontamination import brute as leaked
from test_near_copies import brute as grouped
from test_quality import base

from veilmeter.llm.quality import quality
from veilmeter.llm.shared import written
from veilmeter.llm.sharding import lookup, slots_for


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in cp.STAGES:
        out[name] = written(stage(spark, docs, sf_dir))
        out[name + " in"], docs = docs, out[name]
        if name != "sharding":
            assert docs.columns == columns
    rows = lambda name: {r.doc_id: r.text for r in out[name].collect()}

    passed = rows("quality")
    assert not any(base(t)[-1] for i, t in rows("quality in").items() if i in passed)
    assert {r.doc_id for r in quality(out["quality in"]).where("kept").collect()} == set(passed)

    groups, _ = grouped(passed.items())
    assert set(rows("near_copies")) == {i for i, g in groups.items() if i == g}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = rows("decontamination in")
    assert set(rows("decontamination")) == set(before) - {d for d, _ in leaked(list(before.items()), items)}

    mixed = [r.doc_id for r in out["mixing"].collect()]
    assert set(mixed) <= set(rows("decontamination")) and len(mixed) == len(set(mixed))

    placed = out["sharding"].collect()
    table = lookup([f"shard-{i:03d}" for i in range(16)], slots_for(range(16)))
    assert len(placed) == len(mixed)
    assert all(r["shard"] == f"shard-{table[r['slot']]:03d}" for r in placed)
    assert {r.doc_id for r in cp.run(spark, sf_dir).collect()} == set(mixed)


def test_stages_take_edge_rows(spark, sf_dir):
    for rows in (None, []):
        docs = clashing(documents(spark, rows))
        for name, stage in cp.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= 12
            if name != "sharding":
                assert out.columns == docs.columns


def test_library_without_these_folders(tmp_path):
    """The entry file imports and lists the other queries where this subpackage is missing."""
    import shutil

    root = os.path.dirname(os.path.abspath(cp.__file__))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "tests"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)
