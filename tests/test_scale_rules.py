"""Results that must not depend on sizes, layouts, NULLs or the number of micro-batches."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annoscope.operators import profile as P, social as SO, stats as ST, threshold as TH, vectors as V
from annoscope.plans import sizing
from annoscope.plans.tables import table
from annoscope.sources import sinks
from annoscope.streaming import interval_join as IJ, rowwise as RW


def test_null_group_is_not_the_total(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 1), (None, 1)], "corpus string, label int")
    rates = {r.corpus: r.pos_rate for r in P.positive_rate(df, ["corpus"], total_col="corpus").collect()}
    assert rates == {"a": 0.5, None: 1.0, "all": 0.75}
    ci = {r.corpus: r.n for r in P.mean_ci(df.withColumn("v", F.col("label") * 1.0), ["corpus"], "v").collect()}
    assert ci == {"a": 2, None: 2, "all": 4}


def test_documents_without_known_words_have_zero_vectors(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "?"), (2, "?")], "id long, token string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "token string, vec array<float>")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {(r.id, r.pos): r.value for r in V.doc_vector_sum(tokens, vectors, ids, 2).collect()}
    assert got == {(1, 0): pytest.approx(1 / 5**0.5), (1, 1): pytest.approx(2 / 5**0.5), **{(i, p): 0.0 for i in (2, 3) for p in (0, 1)}}
    mean = {(r.id, r.pos): r.value for r in V.doc_vector_mean(tokens, vectors, ids, 2).collect()}
    assert mean == {(1, 0): 0.5, (1, 1): 0.5, **{(i, p): 0.0 for i in (2, 3) for p in (0, 1)}}


def test_records_do_not_depend_on_the_layout(spark, tmp_path):
    rows = [("k", v) for v in range(7)] + [("big", v) for v in range(100)]
    shapes = []
    for n in (1, 5):
        df = spark.createDataFrame(rows, "key string, value int").repartition(n, "value")
        sinks.write_grouped_json(df, "key", "value", f"{tmp_path}/{n}", record_rows=30)
        lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/{n}").collect()]
        shapes.append(sorted((x["key"], tuple(x["value"])) for x in lines))
    assert shapes[0] == shapes[1]
    assert [v for k, v in shapes[0] if k == "k"] == [tuple(range(7))] and len([1 for k, _ in shapes[0] if k == "big"]) > 1
    assert sorted(v for k, vs in shapes[0] if k == "big" for v in vs) == list(range(100))


def test_stream_join_equals_the_batch_join_over_many_batches(spark, tmp_path):
    rnd = random.Random(1)
    posts = [(i, 1_000_000 * rnd.randrange(100)) for i in range(30)]
    comments = [(100 + k, rnd.randrange(30), 1_000_000 * rnd.randrange(200), rnd.choice(["YTA", "NTA", "x"])) for k in range(400)]
    for name, rows, schema in (("posts", posts, "id long, t long"), ("comments", comments, "id long, parent_id long, t long, label string")):
        df = spark.createDataFrame(rows, schema).withColumn("created", F.timestamp_micros("t")).drop("t")
        df.orderBy(F.rand(3)).repartition(4).write.parquet(f"{tmp_path}/{name}")
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}")
    stream = lambda n: spark.readStream.schema(read(n).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}")
    joined = IJ.windowed_comments_stream(stream("posts"), stream("comments"), window="30 seconds")
    IJ.run_to_table(joined.select("post_id", "id"), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    batch = SO.window_comments(read("posts"), read("comments"), "INTERVAL 30 SECONDS").select("post_id", "id")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, batch.collect())) and len(got) > 50
    assert len([p for p in (tmp_path / "ckpt" / "commits").iterdir() if p.name.isdigit()]) >= 3


def test_row_wise_lookup_finds_every_word(spark):
    words = [f"w{i}" for i in range(500)]
    lex = spark.createDataFrame([(w, d) for i, w in enumerate(words) for d in (["care_virtue"] if i % 2 else ["care_vice", "loyalty_virtue"])], "word string, dim string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "none of these"), (3, None), (4, "")], "id long, text string")
    got = {r.id: r for r in RW.score_lexicon_rowwise(docs, RW.lexicon_map_row(lex), normalize=False, sentiment=True).collect()}
    assert (got[1].care_virtue, got[1].care_vice, got[1].loyalty_virtue) == (250, 250, 250) and got[2].care_vice == 0


def test_topic_pairs_keep_topics_without_a_side(spark):
    cats = ("care",)
    radar = spark.createDataFrame([("t1", "t2", 0.9, 0.1, 1, 0), ("t3", "t1", 0.1, 0.1, 0, 0)],
                                  "topic_1 string, topic_2 string, care_score double, v_care_score double, YA int, NA int")
    got = {(r.topic_a, r.topic_b): (r.n, r.post_rate) for r in SO.topic_pair_rates(radar, cats).collect()}
    assert got == {("t1", "t2"): (1, 1.0), ("t1", "t3"): (0, 0.0), ("t2", "t3"): (0, 0.0)}


def test_broadcast_threshold_is_respected(spark):
    df = spark.range(3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for value, want in (("-1", 0), ("10MB", 10 << 20), ("64k", 64 << 10), ("100", 100)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", value)
            assert sizing.broadcast_limit_bytes(df) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_only_single_split_tables_are_dealt_out(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(100).repartition(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = lambda n: table(spark, str(tmp_path), n)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan("documents") and "Exchange" in plan("lineitem")


def test_thresholds_reach_rows_without_a_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("y_score"))
    thr = df.groupBy("g").agg(F.avg("y_score").alias("threshold"))
    plan = TH.apply_threshold(df, thr, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_rank_test_matches_direct_computation(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(v), int(s)) for g, v, s in zip(rng.integers(0, 2, 300), rng.integers(0, 25, 300) / 4, rng.integers(0, 2, 300))]
    got = {r.g: r for r in ST.mann_whitney(spark.createDataFrame(rows, "g int, v double, s int"), ["g"], "v", "s").collect()}
    for g in (0, 1):
        a, b = [np.array([v for k, v, s in rows if k == g and s == t]) for t in (1, 0)]
        u = sum((x > b).sum() + 0.5 * (x == b).sum() for x in a)
        assert got[g].U == pytest.approx(u) and (got[g].median1, got[g].median2) == (np.median(a), np.median(b))
