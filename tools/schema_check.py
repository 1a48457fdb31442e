"""Compare column types of each registered Spark query with its DuckDB oracle (no data compare).

Usage: python tools/schema_check.py [--sf DIR] [key ...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from annoscope.plans.registry import all_queries  # noqa: E402
from annoscope.plans.tables import TABLES  # noqa: E402
from annoscope.session import local_session  # noqa: E402

SPARK = {"bigint": "i64", "int": "i32", "smallint": "i16", "tinyint": "i8", "double": "f64", "float": "f32",
         "string": "str", "date": "date", "timestamp": "ts", "timestamp_ntz": "ts", "boolean": "bool"}
DUCK = {"BIGINT": "i64", "INTEGER": "i32", "SMALLINT": "i16", "TINYINT": "i8", "DOUBLE": "f64", "FLOAT": "f32",
        "VARCHAR": "str", "DATE": "date", "TIMESTAMP": "ts", "BOOLEAN": "bool", "HUGEINT": "i128"}


def fam_spark(t: str) -> str:
    return "list" if t.startswith("array") else SPARK.get(t, t)


def fam_duck(t: str) -> str:
    t = str(t)
    if t.endswith("[]"):
        return "list"
    if t.startswith("DECIMAL"):
        return "decimal"
    return DUCK.get(t, t)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.001")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    qs = all_queries()
    bad = 0
    for k in a.keys or list(qs):
        q = qs[k]
        if q.sql is None:
            continue
        s = {n: fam_spark(t) for n, t in q.build(spark, a.sf).dtypes}
        rel = con.sql(q.sql)
        d = {n: fam_duck(t) for n, t in zip(rel.columns, rel.types)}
        diff = {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if s.get(c) != d.get(c)}
        if diff:
            bad += 1
            print(f"TYPE {k}: {diff}", flush=True)
    print(f"{bad} queries with type differences", flush=True)


if __name__ == "__main__":
    main()
