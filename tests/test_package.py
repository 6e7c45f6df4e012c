"""Every module imports on its own, and Python functions reach workers that lack the package."""

import os
import pkgutil
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor

import veilmeter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(veilmeter.__file__)))


def modules():
    return [m.name for m in pkgutil.walk_packages(veilmeter.__path__, "veilmeter.")]


def test_modules_import_alone():
    def load(name):
        run = subprocess.run([sys.executable, "-c", f"import {name}"], cwd=ROOT, capture_output=True, text=True, timeout=120)
        return name, run.returncode, run.stderr[-300:]

    with ThreadPoolExecutor(4) as pool:
        failed = [r for r in pool.map(load, modules()) if r[1]]
    assert not failed


def test_operators_do_not_import_plans():
    for folder in ("operators", "functions", "sources", "streaming", "frames"):
        for name in os.listdir(os.path.join(ROOT, "veilmeter", folder)):
            if name.endswith(".py"):
                with open(os.path.join(ROOT, "veilmeter", folder, name), encoding="utf-8") as f:
                    assert "plans" not in [w for line in f if line.startswith(("from", "import")) for w in line.replace(".", " ").split()]


def test_workers_need_no_package(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from veilmeter.session import local_session
from veilmeter.operators.retrieval import nfc
s = local_session("foreign", 2)
print(s.createDataFrame([("e\\u0301",)], "t string").select(nfc("t").alias("t")).collect()[0].t == "\\u00e9")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert run.stdout.strip().endswith("True"), run.stderr[-800:]
