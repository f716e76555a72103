"""Runs registered queries against their DuckDB text: ``python -m tests.compare [key ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return str(v)
    if isinstance(v, list):
        return [cell(x) for x in v]
    return v


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted([tuple(repr(cell(r[i])) for i in order) for r in rows])


def compare(con, sql, df):
    t0 = time.time()
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    compare.spark_seconds = time.time() - t0
    rel = con.execute(sql)
    want = canon([d[0] for d in rel.description], rel.fetchall())
    return got, want


if __name__ == "__main__":
    from tillworks.catalog import checks, queries
    from tillworks.config import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session(8)
    con = duck(folder)
    sqls = checks()
    bad = 0
    for key, fn in queries().items():
        if wanted and not any(key == w or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if key not in sqls:
                n = df.count()
                print(f"ROWS {key}: {n} rows {time.time() - t0:.1f}s", flush=True)
                continue
            (gn, gr), (wn, wr) = compare(con, sqls[key], df)
        except Exception as e:
            bad += 1
            print(f"ERR  {key}: {type(e).__name__} {str(e)[:600]}", flush=True)
            continue
        if gn != wn or gr != wr:
            bad += 1
            print(f"DIFF {key}: spark {len(gr)} rows, check {len(wr)} rows; columns {gn} / {wn}")
            sg, sw = set(gr), set(wr)
            print("   only spark:", [r for r in gr if r not in sw][:2])
            print("   only check:", [r for r in wr if r not in sg][:2], flush=True)
        else:
            print(f"ok   {key}: {len(gr)} rows, spark {compare.spark_seconds:.1f}s of {time.time() - t0:.1f}s", flush=True)
    print("bad:", bad)
