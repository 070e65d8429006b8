"""Runs registered queries beside their SQL twins: python tests/compare.py SF NAME... (or all)."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def compare(spark, sf_dir: str, run, sql: str) -> str:
    """Empty where columns and rows agree, else what differs."""
    df = run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    res = duck(sf_dir).sql(sql)
    want = rows_of(res.columns, res.fetchall())
    if sorted(df.columns) != sorted(res.columns):
        return f"columns {sorted(df.columns)} against {sorted(res.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; first of each {got[:1]} {want[:1]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0][0]} against {bad[0][1]}" if bad else ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from spanwright.session import local_session

    spark = local_session()
    sf = f"/root/testdata/{sys.argv[1]}"
    names = list(e.queries()) if sys.argv[2:] == ["all"] else [n for n in e.queries() if any(n.startswith(p) for p in sys.argv[2:])]
    fails = 0
    for n in names:
        began = time.time()
        try:
            if n in e.oracle_sql():
                why = compare(spark, sf, e.queries()[n], e.oracle_sql()[n])
            else:
                df = e.queries()[n](spark, sf)
                rows = df.collect()
                why, _ = "", print(f"   {n}: {len(rows)} rows, no SQL; {rows[:2]}"[:600])
        except Exception as x:
            why = f"{type(x).__name__}: {str(x)[:1500]}"
        fails += bool(why)
        print(f"{'FAIL' if why else 'ok  '} {n} {time.time() - began:.1f}s {why}"[:1800], flush=True)
    print("failures:", fails, "of", len(names))
