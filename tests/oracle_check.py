"""Run registered queries with Spark and their SQL oracles with DuckDB and
compare row count, column names and an order-insensitive hash of values.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tabulon.session import get_session  # noqa: E402
from tabulon.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return float(v)
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    import __spark_entry__ as E
    spark = get_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, ors = E.queries(), E.oracle_sql()
    bad = 0
    for name in sorted(qs):
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in ors:
            print(f"ROWS {name}: {len(rows)} rows (no oracle) {dt:.2f}s")
            continue
        try:
            cur = con.execute(ors[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        ok_cols = sorted(cols) == sorted(ocols)
        ok_n = len(rows) == len(orows)
        ok_h = ok_cols and digest(cols, rows) == digest(ocols, orows)
        status = "OK  " if (ok_cols and ok_n and ok_h) else "FAIL"
        bad += status != "OK  "
        print(f"{status} {name}: rows {len(rows)}/{len(orows)} cols={ok_cols} hash={ok_h} {dt:.2f}s")
        if status != "OK  ":
            print("   spark cols", cols, "\n   duck cols ", ocols)
            if ok_cols:
                order = sorted(range(len(cols)), key=lambda i: cols[i])
                oorder = [ocols.index(cols[i]) for i in order]
                a = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)
                b = sorted(repr(tuple(norm(r[i]) for i in oorder)) for r in orows)
                diff_a = [x for x in a if x not in set(b)][:3]
                diff_b = [x for x in b if x not in set(a)][:3]
                print("   spark only:", diff_a, "\n   duck only: ", diff_b)
    print("failures:", bad)


if __name__ == "__main__":
    main()
