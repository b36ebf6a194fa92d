"""Compare registered queries with their DuckDB oracle on the same parquet.

    python -m platewise.plans.check [--sf /root/testdata/sf0.01] [key ...]

Rows are compared as multisets after sorting columns by name; values must be
equal exactly (doubles included), NULLs must line up.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import sys
import time
from collections import Counter

import duckdb

from ..sources.adapter import RAW_TABLES
from . import oracle, registry

ORACLE_TABLES = RAW_TABLES + ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in ORACLE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return ("f", 0.0 if v == 0 else v)
    if isinstance(v, decimal.Decimal):
        return ("f", float(v))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, dt.datetime):
        return ("t", v.isoformat())
    if isinstance(v, dt.date):
        return ("d", v.isoformat())
    return ("s", str(v))


def compare(spark, con, key: str, sf_dir: str, df=None) -> tuple[bool, str]:
    """Compare ``df`` (default: the registered query ``key``) with the oracle of ``key``."""
    t0 = time.time()
    if df is None:
        df = registry.QUERIES[key](spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    rel = con.execute(oracle.ORACLE[key])
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    t2 = time.time()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    sc = Counter(tuple(_norm(r[i]) for i in si) for r in s_rows)
    dc = Counter(tuple(_norm(r[i]) for i in di) for r in d_rows)
    info = f"rows spark={len(s_rows)} duck={len(d_rows)} ({t1 - t0:.1f}s / {t2 - t1:.1f}s)"
    if sc == dc:
        return True, info
    only_s = list((sc - dc).elements())[:3]
    only_d = list((dc - sc).elements())[:3]
    return False, f"{info}\n  cols={order}\n  spark-only={only_s}\n  duck-only={only_d}"


def main(argv=None) -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args(argv)
    from ..session import get_session
    spark = get_session(master="local[8]", shuffle_partitions=8)
    con = duck_connection(args.sf)
    keys = args.keys or [k for k in registry.QUERIES if k in oracle.ORACLE]
    bad = 0
    for key in keys:
        try:
            ok, info = compare(spark, con, key, args.sf)
        except Exception as exc:  # report and continue with the next key
            ok, info = False, f"error: {type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(f"{'PASS' if ok else 'FAIL'} {key}: {info}", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} passed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
