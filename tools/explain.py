"""Print the formatted physical plan of registered queries and a one-line shape summary
(exchanges, broadcasts, sort-merge joins, window group limits, Python nodes, pushed filters).

Usage: python tools/explain.py [--sf DIR] [--full] key [key ...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from annoscope.plans.registry import all_queries  # noqa: E402
from annoscope.session import local_session  # noqa: E402


def summary(plan: str) -> str:
    def n(pat):
        return len(re.findall(pat, plan))
    return (f"exchanges={n(r'Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition')} "
            f"broadcast_joins={n(r'BroadcastHashJoin')} smj={n(r'SortMergeJoin')} nlj={n(r'BroadcastNestedLoopJoin')} "
            f"window_group_limit={n(r'WindowGroupLimit')} windows={n(r'Window \[')} python={n(r'ArrowEvalPython|MapInArrow|MapInPandas|BatchEvalPython')} "
            f"scans={n(r'Scan parquet')} pushed_filters={n(r'PushedFilters: \[[^\]]')}")


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--full", action="store_true")
    ap.add_argument("keys", nargs="+")
    a = ap.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    qs = all_queries()
    for k in a.keys:
        df = qs[k].build(spark, a.sf)
        plan = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        print(f"== {k}: {summary(plan)}")
        if a.full:
            print(plan)


if __name__ == "__main__":
    main()
