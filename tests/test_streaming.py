from pyspark.sql import functions as F

from annoscope.streaming.micro_batch import score_stream


def test_micro_batch_scorer_matches_batch(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    rows = [(i, f"word{i % 7} other text") for i in range(40)]
    spark.createDataFrame(rows, "id long, text string").repartition(4).write.parquet(src)
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(src)

    def score(batch):
        return batch.select("id", F.length("text").alias("n"))

    score_stream(stream, score, out, ck).awaitTermination()
    got = spark.read.parquet(out)
    assert got.select("batch_id").distinct().count() >= 2          # several micro-batches
    assert sorted((r.id, r.n) for r in got.drop("batch_id").collect()) == sorted((i, len(t)) for i, t in rows)


def test_stream_window_join_bounds(spark, tmp_path):
    import datetime as dt

    from annoscope.streaming.interval_join import run_to_table, windowed_comments_stream

    t0 = dt.datetime(2020, 1, 1)
    pdir, cdir = str(tmp_path / "p"), str(tmp_path / "c")
    spark.createDataFrame([(1, t0)], "id long, created timestamp").write.parquet(pdir)
    spark.createDataFrame([("early", 1, t0 - dt.timedelta(hours=2), "YTA"), ("in", 1, t0 + dt.timedelta(hours=5), "NTA"),
                           ("late", 1, t0 + dt.timedelta(hours=30), "NTA"), ("info", 1, t0, "INFO")],
                          "id string, parent_id long, created timestamp, label string").write.parquet(cdir)
    ps = spark.readStream.schema("id long, created timestamp").parquet(pdir)
    cs = spark.readStream.schema("id string, parent_id long, created timestamp, label string").parquet(cdir)
    j = windowed_comments_stream(ps, cs, window="18 hours", lookback="18 hours")
    out = str(tmp_path / "out")
    run_to_table(j.select(F.col("id").alias("comment_id")), out, str(tmp_path / "ck"))
    assert sorted(r.comment_id for r in spark.read.parquet(out).collect()) == ["early", "in"]


def test_a_micro_batch_holds_work_for_every_core_and_outweighs_the_table_it_joins(spark):
    from annoscope.streaming.micro_batch import CORE_BYTES, batch_bytes

    cores = spark.sparkContext.defaultParallelism
    assert batch_bytes(spark) == cores * CORE_BYTES and batch_bytes(spark, cores * CORE_BYTES) == 2 * cores * CORE_BYTES


def test_streamed_scores_do_not_read_the_corpus_lexicon_once_a_file(spark):
    from annoscope.plans.catalog import lexicon as LC, streaming as ST

    from conftest import SF_SMALL

    seen = []
    real = ST.MB.score_stream

    def counted(stream, score, path, ck, **kw):
        return real(stream, lambda batch: (seen.append(1), score(batch))[1], path, ck, **kw)

    ST.MB.score_stream = counted
    try:
        got = ST.stream_score_problex(spark, SF_SMALL)
    finally:
        ST.MB.score_stream = real
    assert len(seen) == 1  # four files, one micro-batch
    key = lambda rows: sorted(map(tuple, rows))
    assert key(got.collect()) == key(LC.score_problex(spark, SF_SMALL).select(got.columns).collect())
