"""Run registered Spark queries and their DuckDB twins side by side.

    python tests/oracle_check.py [sf_dir] [name ...]

Compares column names, row counts, coarse column types and the multiset of
row values. Used by tests/test_oracle.py and by hand while developing.
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402,I001

from shoplens.sources.tables import TABLES  # noqa: E402


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    if isinstance(v, decimal.Decimal):
        return "decimal"
    if isinstance(v, str):
        return "str"
    if isinstance(v, dt.datetime):
        return "ts"
    if isinstance(v, dt.date):
        return "date"
    if isinstance(v, (list, tuple)):
        return "list"
    return type(v).__name__


def _norm(v):
    if isinstance(v, dict):  # a struct
        return tuple(_norm(x) for x in v.values())
    if isinstance(v, float) and v != v:
        return "NaN"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    problems = []
    if sorted(spark_cols) != sorted(duck_cols):
        problems.append(f"columns differ: spark={spark_cols} duck={duck_cols}")
        return problems
    if len(spark_rows) != len(duck_rows):
        problems.append(f"row count spark={len(spark_rows)} duck={len(duck_rows)}")
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    sk = [{_kind(r[i]) for r in spark_rows} - {None} for i in si]
    dk = [{_kind(r[i]) for r in duck_rows} - {None} for i in di]
    for c, a, b in zip(order, sk, dk):
        if a and b and a != b:
            problems.append(f"type of {c}: spark={a} duck={b}")
    s = Counter(tuple(_norm(r[i]) for i in si) for r in spark_rows)
    d = Counter(tuple(_norm(r[i]) for i in di) for r in duck_rows)
    if s != d:
        only_s = list((s - d).elements())[:3]
        only_d = list((d - s).elements())[:3]
        problems.append(f"values differ ({sum((s - d).values())} vs {sum((d - s).values())} rows);"
                        f" cols={order}\n   spark-only {only_s}\n   duck-only {only_d}")
    return problems


def run(names=None, sf_dir="/root/testdata/sf0.01", spark=None, verbose=True):
    import __spark_entry__ as E
    from shoplens.session import build_session
    spark = spark or build_session("local[8]", shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    names = names or list(qs)
    results = {}
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            results[n] = [f"spark error: {str(e)[:600]}"]
            if verbose:
                print(f"FAIL {n}: spark error {str(e)[:600]}")
            continue
        t1 = time.time()
        if n not in sqls:
            results[n] = []
            if verbose:
                print(f"rows {n}: {len(rows)} rows spark {t1 - t0:.1f}s (no oracle)")
            continue
        try:
            cur = con.execute(sqls[n])
            drows = cur.fetchall()
            dcols = [d[0] for d in cur.description]
        except Exception as e:  # noqa: BLE001
            results[n] = [f"duckdb error: {str(e)[:600]}"]
            if verbose:
                print(f"FAIL {n}: duckdb error {str(e)[:600]}")
            continue
        p = compare(rows, cols, drows, dcols)
        results[n] = p
        if verbose:
            print(("ok   " if not p else "FAIL ") + f"{n}: {len(rows)} rows spark {t1 - t0:.1f}s"
                  + ("" if not p else "\n  " + "\n  ".join(p)))
    return results


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    res = run(args or None, sf)
    bad = [n for n, p in res.items() if p]
    print(f"{len(res) - len(bad)}/{len(res)} ok; failing: {bad}")
