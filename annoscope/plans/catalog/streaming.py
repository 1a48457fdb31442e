"""Streaming group: the row-wise lexicon scorer (same result as ``score_lexicon``) and the
stream-stream windowed post/comment join drained with an ``availableNow`` trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoscope.functions import models as M
from annoscope.operators import text as T, train as TR, vectors as V
from annoscope.plans import fixtures as fx
from annoscope.plans.catalog import fitted as FC, lexicon as LC, vectors as VC
from annoscope.plans.catalog._util import rounded
from annoscope.plans.catalog.social import BASE, WINDOW_SQL
from annoscope.plans.registry import register
from annoscope.schema import CATEGORIES
from annoscope.session import scratch_path, written
from annoscope.streaming import interval_join as IJ, micro_batch as MB, rowwise as RW

#: Bytes of a number of a written table, at most, by which a word's row in a lexicon or cosine table is sized.
_NUMBER_BYTES = 8


@register("score_lexicon_rowwise", "streaming", sql=LC._SCORE_LEX_SQL)
def score_lexicon_rowwise(spark, sf):
    lex_row = RW.lexicon_map_row(fx.lexicon_a(spark), fx.lemma_map(spark))
    return rounded(RW.score_lexicon_rowwise(fx.texts(spark, sf), lex_row))


@register("stream_window_join", "streaming", sql=BASE + f"""SELECT c.parent_id AS post_id, c.id AS comment_id, c.label
FROM comments c JOIN posts p ON c.parent_id = p.id AND c.created <= p.created + {WINDOW_SQL}
WHERE c.label IN ('YTA', 'NTA', 'ESH', 'NAH')""")
def stream_window_join(spark, sf):
    base = scratch_path(spark, "stream")
    fx.posts(spark, sf).select("id", "created").write.parquet(f"{base}/posts")
    fx.comments(spark, sf).select("id", "parent_id", "created", "label").write.parquet(f"{base}/comments")
    # TIMESTAMP + INTERVAL follows the session time zone (a DST day is 23 or 25 hours), so the
    # stream runs in a UTC child session: windows are exact, as in the batch join on wall time
    utc = spark.newSession()
    utc.conf.set("spark.sql.session.timeZone", "UTC")
    ps = utc.readStream.schema("id long, created timestamp_ntz").parquet(f"{base}/posts")
    cs = utc.readStream.schema("id string, parent_id long, created timestamp_ntz, label string").parquet(f"{base}/comments")
    # timestamp_ntz is not a watermark type; the stream uses the UTC instant of the same wall time
    # (exact micros since the epoch, independent of the session time zone)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ps = ps.withColumn("created", F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("created"))))
    cs = cs.withColumn("created", F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("created"))))
    joined = IJ.windowed_comments_stream(ps, cs, window=f"{fx.POST_WINDOW_DAYS} days")
    out = joined.select("post_id", F.col("id").alias("comment_id"), "label")
    IJ.run_to_table(out, f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out")


@register("stream_score_problex", "streaming", sql=LC._PROBLEX_SQL)
def stream_score_problex(spark, sf):
    """Probability-lexicon scores of documents arriving as a stream (micro-batches of files). The lexicon is written once, each
    micro-batch joins it."""
    from annoscope.operators import lexicon as L

    base = scratch_path(spark, "stream_problex")
    fx.texts(spark, sf).write.parquet(f"{base}/in")
    words = fx.vocabulary(spark, sf)
    lex = written(fx.lexicon_b(spark, sf, words).select("word", *[f"{c}_p" for c in CATEGORIES]), "lexicon")
    frequent = fx.frequent_words(words)
    size = MB.batch_bytes(spark, lex.count() * (1 + len(CATEGORIES)) * _NUMBER_BYTES)
    stream = spark.readStream.schema("id long, text string").option("maxBytesPerTrigger", size).parquet(f"{base}/in")

    def score(batch):
        content = T.content_tokens(T.token_table(batch, lower=False))
        return L.score_problex(content, lex, ids=batch.select("id"), frequent=frequent)

    MB.score_stream(stream, score, f"{base}/out", f"{base}/ckpt").awaitTermination()
    return rounded(spark.read.parquet(f"{base}/out").drop("batch_id"))


@register("stream_score_embed", "streaming", sql=VC.SCORE_EMBED_SQL)
def stream_score_embed(spark, sf):
    """E4 on a stream: the cosines of words and concepts are written once, each micro-batch of documents joins them."""
    base = scratch_path(spark, "stream_embed")
    fx.texts(spark, sf).write.parquet(f"{base}/in")
    words, cosines = VC._words_cos(spark, sf)
    cosines, frequent = written(cosines, "token-cosines"), fx.frequent_words(words)
    size = MB.batch_bytes(spark, cosines.count() * 2 * _NUMBER_BYTES)
    stream = spark.readStream.schema("id long, text string").option("maxBytesPerTrigger", size).parquet(f"{base}/in")

    def score(batch):
        return V.score_embedding(T.token_table(batch), cosines, ids=batch.select("id"), frequent=frequent)

    MB.score_stream(stream, score, f"{base}/out", f"{base}/ckpt").awaitTermination()
    return rounded(spark.read.parquet(f"{base}/out").drop("batch_id"))


@register("stream_batch_model", "streaming", sql=FC.SCORE_BATCH_SQL)
def stream_batch_model(spark, sf):
    """K12 on a stream: the user model scores the rows as they arrive, without state or shuffle; the file sink commits each batch once."""
    base = scratch_path(spark, "stream_model")
    fx.ml_features(spark, sf).select("id", "vec").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("id long, vec array<float>").option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    schema = "id long, " + ", ".join(f"{c}_score double" for c in CATEGORIES)
    scored = TR.batch_score(stream, "vec", M.load_linear_model, M.predict_linear, schema)
    (scored.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
     .trigger(availableNow=True).start().awaitTermination())
    return rounded(spark.read.schema(schema).parquet(f"{base}/out"))
