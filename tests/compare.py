"""Runs queries against their SQL, as the driver does: ``python tests/compare.py SF_DIR [NAME ...]``."""

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(d):
    c = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, c, d, name, fn, sql):
    t = time.time()
    df = fn(spark, d)
    got = df.collect()
    took = time.time() - t
    if sql is None:
        return f"{name:28s} rows {len(got):7d} {took:6.1f}s  (no SQL)", True
    cur = c.execute(sql)
    columns = [x[0] for x in cur.description]
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"{name:28s} COLUMNS {sorted(df.columns)} vs {sorted(columns)}", False
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(columns, want)
    ok = a == b
    text = f"{name:28s} rows {len(got):7d} {took:6.1f}s  {'ok' if ok else f'MISMATCH sql {len(want)}'}"
    if not ok:
        text += f"\n   only Spark {list((a - b).items())[:3]}\n   only SQL {list((b - a).items())[:3]}"
    return text, ok


if __name__ == "__main__":
    import __spark_entry__ as e

    from tidemark.session import local_session

    spark = local_session(8, "compare")
    spark.sparkContext.setLogLevel("ERROR")
    d, names = sys.argv[1], sys.argv[2:]
    q, s = e.queries(), e.oracle_sql()
    c = connect(d)
    for n in names or q:
        try:
            print(check(spark, c, d, n, q[n], s.get(n))[0], flush=True)
        except Exception as x:  # noqa: BLE001
            print(f"{n:28s} ERROR {str(x)[:600]}", flush=True)
