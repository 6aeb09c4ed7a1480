"""Run registered queries and their SQL side by side: ``python -m tests.compare [-s 0.01] [name ...]``."""
from __future__ import annotations

import math
import sys
import time

import duckdb

from statuta import plans
from statuta.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, float):
        return "%.9g" % (v + 0.0)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def kind(dtype: str) -> str:
    d = dtype.lower()
    for key in ("bigint", "int", "double", "string", "varchar", "boolean", "timestamp", "float", "date"):
        if d.startswith(key):
            return {"varchar": "string", "int": "int"}.get(key, key)
    return {"integer": "int", "hugeint": "hugeint"}.get(d, d)


def compare(spark, con, name, folder, queries, oracles):
    """(ok, message) of one query against its SQL."""
    started = time.time()
    df = queries[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if name not in oracles:
        return True, f"rows only: {len(got)} rows, {took:.1f}s"
    cursor = con.execute(oracles[name])
    names = [c[0] for c in cursor.description]
    kinds = {c[0]: kind(str(c[1])) for c in cursor.description}
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    odd = [f"{n}: {t} != {kinds[n]}" for n, t in df.dtypes if kind(t) != kinds[n]]
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:3]
        only_b = [x for x in b if x not in set(a)][:3]
        return False, f"{len(a)} vs {len(b)} rows ({took:.1f}s)\n   cols  {sorted(names)}\n   spark {only_a}\n   sql   {only_b}"
    return not odd, f"{len(a)} rows, {took:.1f}s {odd or ''}"


def main(argv):
    scale = "0.01"
    if argv[:1] == ["-s"]:
        scale, argv = argv[1], argv[2:]
    folder = f"/root/testdata/sf{scale}"
    queries, oracles = plans.load()
    spark = local_session()
    con = connect(folder)
    bad = []
    for name in argv or queries:
        try:
            ok, message = compare(spark, con, name, folder, queries, oracles)
        except Exception as e:  # noqa: BLE001 - every query is tried
            ok, message = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", name, message, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed", *bad)


if __name__ == "__main__":
    main(sys.argv[1:])
