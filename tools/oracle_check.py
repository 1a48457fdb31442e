"""Local correctness check: run each registered Spark query and its DuckDB oracle side by side.

Usage: python tools/oracle_check.py [--sf DIR] [--group G] [key ...]
Compares row count, column names and an order-insensitive value multiset (doubles rounded to 6).
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402

from annoscope.plans.registry import all_queries  # noqa: E402
from annoscope.plans.tables import TABLES  # noqa: E402
from annoscope.session import local_session  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, (np.generic,)):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return norm(float(v))
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    try:
        import pandas as pd
        if v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, pd.Timestamp):
            return v.to_pydatetime().isoformat()
    except Exception:
        pass
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--group", default=None)
    ap.add_argument("--tz", default=None, help="session time zone to run Spark under")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    if a.tz:
        spark.conf.set("spark.sql.session.timeZone", a.tz)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    qs = all_queries()
    keys = a.keys or [k for k, q in qs.items() if a.group is None or q.group == a.group]
    bad = 0
    for k in keys:
        q = qs[k]
        t0 = time.time()
        try:
            sdf = q.build(spark, a.sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:600]}", flush=True)
            bad += 1
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"ROWS {k}: {len(srows)} rows (no oracle) {ts:.1f}s", flush=True)
            continue
        try:
            res = con.execute(q.sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(e)[:600]}", flush=True)
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {k}: columns spark={sorted(scols)} duck={sorted(dcols)}", flush=True)
            bad += 1
            continue
        sr, dr = rows_of(scols, srows), rows_of(dcols, drows)
        if len(sr) != len(dr):
            print(f"FAIL {k}: rows spark={len(sr)} duck={len(dr)}", flush=True)
            bad += 1
            continue
        if sr != dr:
            diff = [(x, y) for x, y in zip(sr, dr) if x != y][:3]
            print(f"FAIL {k}: values differ ({sum(1 for x, y in zip(sr, dr) if x != y)} rows) cols={sorted(scols)}", flush=True)
            for x, y in diff:
                print("   spark:", x)
                print("   duck: ", y)
            bad += 1
            continue
        print(f"OK   {k}: {len(sr)} rows {ts:.1f}s", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
