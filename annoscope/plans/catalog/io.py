"""I/O group: every reader is checked by a round trip of driver-derived tables through files in
the shared checkpoint folder; the oracle is the source table itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoscope.functions.hashing import u01
from annoscope.plans import fixtures as fx, sqlfrag as S
from annoscope.plans.catalog._util import rounded
from annoscope.plans.registry import register
from annoscope.plans.tables import table
from annoscope.schema import CATEGORIES
from annoscope.session import scratch_path
from annoscope.sources import readers, sinks


@register("src_csv", "io", sql="SELECT doc_id, text, lang FROM documents")
def src_csv(spark, sf):
    path = scratch_path(spark, "documents_csv")
    sinks.write_csv(table(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    return readers.read_csv(spark, path, "doc_id long, text string, lang string")


@register("src_tsv", "io", sql="SELECT page_id, url FROM pages")
def src_tsv(spark, sf):
    path = scratch_path(spark, "pages_tsv")
    sinks.write_csv(table(spark, sf, "pages").select("page_id", "url"), path, sep="\t", encoding="ISO-8859-1")
    return readers.read_tsv(spark, path, "page_id long, url string", encoding="ISO-8859-1")


@register("src_nested_json", "io", sql=S.with_(S.TWEETS) + "SELECT corpus, tweet_id, tweet_text, CAST(annotator AS VARCHAR) AS annotator, annotation FROM tweets")
def src_nested_json(spark, sf):
    path = scratch_path(spark, "tweets_json")
    sinks.write_nested_corpus_json(fx.tweets_flat(spark, sf), path)
    return readers.read_nested_json(spark, path).select("corpus", "tweet_id", "tweet_text", "annotator", "annotation")


@register("src_json_document", "io", sql=S.with_(S.TWEETS) + "SELECT corpus, tweet_id, tweet_text, CAST(annotator AS VARCHAR) AS annotator, annotation FROM tweets")
def src_json_document(spark, sf):
    """A6 as shipped: one list of corpora in one file, on many lines."""
    path = scratch_path(spark, "corpora_json")
    tweet = fx.tweets_flat(spark, sf).groupBy("corpus", "tweet_id", "tweet_text").agg(
        F.collect_list(F.struct(F.col("annotator").cast("string").alias("annotator"), "annotation")).alias("annotations"))
    value = F.to_json(F.struct("tweet_id", "tweet_text", "annotations"), {"pretty": "true"})
    sinks.write_corpora_document(tweet.select("corpus", value.alias("value")), path)
    return readers.read_corpora_json(spark, path).select("corpus", "tweet_id", "tweet_text", "annotator", "annotation")


@register("src_json_object", "io", sql="SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS text, p_brand AS issue, "
          "CASE WHEN p_size % 2 = 1 THEN 'democratic' ELSE 'republican' END AS party, 'care' AS category FROM part")
def src_json_object(spark, sf):
    """A7 as shipped: one object keyed by id in one file, on many lines."""
    p = table(spark, sf, "part")
    path = scratch_path(spark, "frames_object")
    value = F.to_json(F.struct(F.col("p_name").alias("text"), F.pmod("p_size", F.lit(2)).alias("author-label"), F.col("p_brand").alias("issue")))
    sinks.write_json_document(p.select(F.col("p_partkey").alias("id"), value.alias("value")), path, key="id")
    return readers.read_map_json(spark, {"care": path}, one_object_per_line=False).select("id", "text", "issue", "party", "category")


_FRAME_CAT = f"{S.cats_list()}[CAST(floor({S.u01('p_partkey', S.q('frame'))} * {len(CATEGORIES)}) AS INTEGER) + 1]"


@register("src_map_json", "io", sql=f"""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS text, p_brand AS issue,
  CASE WHEN p_size % 2 = 1 THEN 'democratic' ELSE 'republican' END AS party, {_FRAME_CAT} AS category FROM part""")
def src_map_json(spark, sf):
    p = table(spark, sf, "part")
    cat = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]),
                       (F.floor(u01("p_partkey", F.lit("frame")) * len(CATEGORIES)) + 1).cast("int"))
    frames = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.pmod("p_size", F.lit(2)).alias("author-label"),
                      F.col("p_brand").alias("issue"), cat.alias("category"))
    base = scratch_path(spark, "frames_json")
    paths = {}
    for c in CATEGORIES:
        paths[c] = f"{base}/{c}"
        sinks.write_keyed_json(frames.where(F.col("category") == c), "id", ["text", "author-label", "issue"], paths[c])
    return readers.read_map_json(spark, paths).select("id", "text", "issue", "party", "category")


@register("src_wordvec", "io", sql=S.with_(S.TOKENS, S.WORD_VECTORS) + """SELECT token, CAST(len(vec) AS INTEGER) AS dims,
  round(sqrt(list_sum(list_transform(vec, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 6) AS norm FROM word_vectors""")
def src_wordvec(spark, sf):
    path = scratch_path(spark, "word_vectors_txt")
    sinks.write_word_vectors(fx.word_vectors(spark, sf), path)
    v = readers.read_word_vectors(spark, path)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rounded(v.select("token", F.size("vec").alias("dims"), norm.alias("norm")))


@register("sink_roundtrip", "io", sql=" UNION ALL ".join(
    f"SELECT '{f}' AS format, doc_id, n_chars, lang, source FROM documents" for f in ("parquet", "json", "csv")))
def sink_roundtrip(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    schema = "doc_id long, n_chars long, lang string, source string"
    base = scratch_path(spark, "sink")
    sinks.write_parquet(d, f"{base}/p", partition_by=["lang"])
    sinks.write_json_lines(d, f"{base}/j")
    sinks.write_csv(d, f"{base}/c", mode="warn_overwrite")
    p = spark.read.parquet(f"{base}/p").select("doc_id", "n_chars", "lang", "source")
    j = spark.read.schema(schema).json(f"{base}/j")
    c = readers.read_csv(spark, f"{base}/c", schema)
    return (p.withColumn("format", F.lit("parquet")).unionByName(j.withColumn("format", F.lit("json")))
            .unionByName(c.withColumn("format", F.lit("csv"))))
