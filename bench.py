"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is planned and fully executed into Spark's ``noop`` sink (no driver collect), after one
untimed warm-up of the session. Times are wall-clock seconds per query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "score_lexicon", "score_lexicon_rowwise", "score_problex", "score_embed", "feat_tfidf",
    "eval_roc", "eval_auc_grid", "eval_report", "eval_kfold", "thr_max_f1",
    "aita_filter", "aita_verdict_join", "topic_pair_rates", "stat_or_matrix", "stat_mwu",
    "emfd_counts", "split_kfold", "corpus_profile",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from annoscope.plans.registry import all_queries
    from annoscope.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="annoscope-bench")
    spark.sparkContext.setLogLevel("ERROR")
    qs = all_queries()
    spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        t0 = time.time()
        qs[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
