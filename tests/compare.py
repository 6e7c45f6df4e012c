"""Run registered queries and their SQL on the same files and compare rows exactly."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PLAIN = {"BIGINT", "INTEGER", "VARCHAR", "BOOLEAN", "DOUBLE"}
SPARK = {"bigint": "BIGINT", "int": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def database(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in at)) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """Problem text, or None; also the row count and seconds."""
    t = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - t
    if sql is None:
        return (None if got else "no rows"), len(got), seconds
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    types = {c[0]: str(c[1]).upper() for c in rel.description}
    want = rel.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} / {sorted(cols)}", len(got), seconds
    odd = {c: t for c, t in types.items() if t not in PLAIN}
    if odd:
        return f"SQL types {odd}", len(got), seconds
    mixed = {c: (t, types[c]) for c, t in df.dtypes
             if SPARK.get(t) != types[c].replace("INTEGER", "BIGINT")}
    if mixed:
        return f"types differ {mixed}", len(got), seconds
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        extra = [x for x in a if x not in set(b)][:3]
        lost = [x for x in b if x not in set(a)][:3]
        return f"{len(a)} / {len(b)} rows; only ours {extra}; only SQL {lost}", len(got), seconds
    return (None if got else "no rows"), len(got), seconds


if __name__ == "__main__":
    from veilmeter.session import local_session

    import __spark_entry__ as entry

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session("compare")
    con = database(f"/root/testdata/sf{sf}")
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            problem, n, s = compare(
                spark, con, name, fn, entry.oracle_sql().get(name), f"/root/testdata/sf{sf}"
            )
        except Exception as e:  # noqa: BLE001 - report and go on
            problem, n, s = f"{type(e).__name__}: {str(e)[:600]}", 0, 0.0
        bad += problem is not None
        mark = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {name:40} {mark:4} {n:7} {s:6.2f}s {problem or ''}"[:1500], flush=True)
    print("failures:", bad)
