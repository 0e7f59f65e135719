"""Run catalog queries in Spark and their DuckDB oracles side by side.

    python tools/oracle_check.py [--sf DIR] [name ...]

Compares column names, row counts and an order-insensitive hash of the rows
(columns sorted by name), like the driver's correctness gate.  Floats are also
compared after rounding to 9 significant digits to tell real mismatches from
last-bit noise.
"""

from __future__ import annotations

import argparse
import decimal
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from shopsight.plans.catalog import load_all  # noqa: E402
from shopsight.session import get_session  # noqa: E402
from shopsight.sources.testdata import TABLES  # noqa: E402


def _norm(v, approx: bool):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") if approx else v
    if isinstance(v, decimal.Decimal):
        return float(v) if approx else str(v.normalize())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, approx) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist(), approx)
    return v


def _digest(rows, approx: bool) -> str:
    keyed = sorted(repr(tuple(_norm(x, approx) for x in r)) for r in rows)
    return hashlib.sha256("\n".join(keyed).encode()).hexdigest()[:16]


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = get_session(master="local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    reg = load_all()
    names = a.names or list(reg)
    bad = 0
    for n in names:
        q = reg[n]
        t0 = time.time()
        try:
            sdf = q.build(spark, a.sf)
            cols = sorted(sdf.columns)
            srows = [tuple(r[c] for c in cols) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{n:24s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if not q.sql:
            print(f"{n:24s} rows-only  spark_rows={len(srows)} {ts:.1f}s")
            continue
        try:
            res = con.execute(q.sql)
            dcols = [d[0] for d in res.description]
            drows_raw = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{n:24s} DUCK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        if sorted(dcols) != cols:
            print(f"{n:24s} COLUMNS spark={cols} duck={sorted(dcols)}")
            bad += 1
            continue
        idx = [dcols.index(c) for c in cols]
        drows = [tuple(r[i] for i in idx) for r in drows_raw]
        exact = _digest(srows, False) == _digest(drows, False)
        approx = _digest(srows, True) == _digest(drows, True)
        status = "OK" if exact else ("APPROX" if approx else "MISMATCH")
        if not exact:
            bad += 1
        print(f"{n:24s} {status:8s} spark_rows={len(srows)} duck_rows={len(drows)} {ts:.1f}s")
        if status != "OK" and os.environ.get("SHOW"):
            ap = status == "MISMATCH"
            s1 = sorted(repr(tuple(_norm(x, ap) for x in r)) for r in srows)
            d1 = sorted(repr(tuple(_norm(x, ap) for x in r)) for r in drows)
            only_s = sorted(set(s1) - set(d1))[:5]
            only_d = sorted(set(d1) - set(s1))[:5]
            print("   cols:", cols)
            print("   spark only:", *only_s, sep="\n     ")
            print("   duck only:", *only_d, sep="\n     ")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
