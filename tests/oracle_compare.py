"""Run Spark queries and their DuckDB oracle side by side (the driver's check, locally).

usage: python tests/oracle_compare.py [sf_dir] [query ...]
"""
from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from shipshape.session import get_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if type(v).__name__ == "date" else v.isoformat()
    return repr(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = get_session(os.environ.get("COMPARE_MASTER", "local[8]"), 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, ors = queries(), oracle_sql()
    bad = 0
    for n in names or list(qs):
        t0 = time.time()
        try:
            df = qs[n](spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: spark error {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in ors:
            print(f"ROWS {n}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(ors[n])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        hs, ls = digest(scols, srows)
        ho, lo = digest(ocols, orows)
        ok = sorted(scols) == sorted(ocols) and len(srows) == len(orows) and hs == ho
        if ok:
            print(f"OK   {n}: {len(srows)} rows {ts:.1f}s")
        else:
            bad += 1
            print(f"FAIL {n}: cols {sorted(scols) == sorted(ocols)} {sorted(scols)} vs {sorted(ocols)}; "
                  f"rows {len(srows)} vs {len(orows)}")
            sset, oset = set(ls), set(lo)
            print("   spark-only:", sorted(sset - oset)[:3])
            print("   duck-only: ", sorted(oset - sset)[:3])
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
