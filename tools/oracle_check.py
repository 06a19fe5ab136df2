"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name-prefix ...]
Prints one line per query: rows, column names, and whether the sorted,
rounded row multisets agree.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from stepcorpus.plans.registry import load_all  # noqa: E402
from stepcorpus.session import get_session  # noqa: E402
from stepcorpus.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = get_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    reg = load_all()
    bad = 0
    for name, qd in sorted(reg.items()):
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            sdf = qd.build(spark, sf)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:34s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if qd.sql is None:
            print(f"{name:34s} rows={len(srows):7d} spark={ts:6.2f}s  (no oracle)")
            continue
        try:
            res = con.execute(qd.sql)
            dcols = [c[0] for c in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:34s} DUCKDB ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        same_cols = sorted(scols) == sorted(dcols)
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        ok = same_cols and a == b
        bad += not ok
        msg = f"{name:34s} rows={len(srows):7d}/{len(drows):7d} spark={ts:6.2f}s {'OK' if ok else 'MISMATCH'}"
        if not same_cols:
            msg += f" cols spark={scols} duck={dcols}"
        elif not ok:
            sa, sb = set(a), set(b)
            only_s = [r for r in a if r not in sb][:2]
            only_d = [r for r in b if r not in sa][:2]
            msg += f"\n   spark-only: {str(only_s)[:600]}\n   duck-only:  {str(only_d)[:600]}"
        print(msg, flush=True)
    print(f"failures: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
