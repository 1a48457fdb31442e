"""Inputs of the reference's shapes, derived from the driver tables (FIXTURES.md part 2).

Every fixture is a lazy DataFrame over the driver tables, so its size grows with them. Each has
a DuckDB twin in ``annoscope.plans.sqlfrag`` built from the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from annoscope.functions.hashing import u01
from annoscope.functions.text import SENTENCE_PATTERN, TOKEN_PATTERN
from annoscope.plans.tables import table

__all__ = ["table"]
from annoscope.schema import CATEGORIES

# The inline lemma map of the fixture.
LEMMA_ROWS: tuple[tuple[str, str], ...] = (("are", "be"), ("was", "be"))

# The inline lexicon A of the fixture (word, dimension).
LEXICON_A_ROWS: tuple[tuple[str, str], ...] = (
    ("the", "authority_virtue"), ("und", "authority_virtue"), ("der", "authority_vice"),
    ("with", "care_virtue"), ("be", "care_vice"), ("for", "fairness_virtue"),
    ("que", "fairness_vice"), ("this", "loyalty_virtue"), ("from", "loyalty_vice"),
    ("die", "loyalty_vice"), ("that", "sanctity_virtue"), ("that", "care_virtue"),
    ("and", "sanctity_vice"),
)

# Raw annotation names of the Reddit corpus and their categories.
REDDIT_LABEL_MAP: tuple[tuple[str, str], ...] = (
    ("Thin Morality", "none"), ("Non-Moral", "none"), ("Care", "care"), ("Purity", "sanctity"),
    ("Authority", "authority"), ("Loyalty", "loyalty"), ("Proportionality", "fairness"),
    ("Equality", "fairness"),
)

# Raw annotation names of the Twitter corpus and their categories.
TWITTER_LABEL_MAP: tuple[tuple[str, str], ...] = (
    ("non-moral", "none"), ("nm", "none"), ("nh", "none"), ("care", "care"), ("harm", "care"),
    ("purity", "sanctity"), ("degradation", "sanctity"), ("authority", "authority"),
    ("subversion", "authority"), ("loyalty", "loyalty"), ("betrayal", "loyalty"),
    ("fairness", "fairness"), ("cheating", "fairness"),
)

# Comment label from (returnflag || linestatus); RO -> NULL.
COMMENT_LABELS: tuple[tuple[str, str | None], ...] = (
    ("AF", "YTA"), ("RF", "NTA"), ("NO", "ESH"), ("AO", "NAH"), ("NF", "INFO"), ("RO", None),
)

# Stance from the order status.
STANCE_MAP: tuple[tuple[str, str], ...] = (("O", "FAVOR"), ("F", "AGAINST"), ("P", "NONE"))

# The post filter parameters of the fixture (scaled from 18 h / 50 / 0.7).
POST_WINDOW_DAYS = 1200
POST_MIN_JUDGMENTS = 8
POST_BALANCE = 0.7
HIGHLIGHT_CODERS = (0, 1, 2, 3, 549)


def _map_expr(col, pairs):
    m = F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(v))])
    return m[col]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def tokens(spark: SparkSession, sf_dir: str, lower: bool = True) -> DataFrame:
    """Token table ``(id, pos, token)`` of ``documents``."""
    from annoscope.operators.text import token_table
    return token_table(texts(spark, sf_dir), lower=lower)


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, token, tf)`` per document."""
    return tokens(spark, sf_dir).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(token, n)``: corpus frequency of every distinct token. One aggregation combined map-side
    (far fewer rows than ``(id, token)`` pairs), written once; a query passes it to all fixtures that derive from it."""
    from annoscope.plans.sizing import shared
    # read by the vector lookup, the seed lists and the probability lexicon under different filters
    return shared(tokens(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("n")))


def lemma_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEMMA_ROWS), "token string, lemma string")


def lexicon_a(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON_A_ROWS), "word string, dim string")


def frequent_words(words: DataFrame) -> DataFrame:
    """``(key)``: the most frequent words of a query's ``vocabulary``."""
    from annoscope.operators.skew import counted_frequent_keys
    return counted_frequent_keys(words, "token")


def lexicon_b(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """Probability lexicon of every distinct token. ``words`` is the query's ``vocabulary``, if it has one already."""
    words = vocabulary(spark, sf_dir) if words is None else words
    vocab = words.select(F.col("token").alias("word"))
    cols = [u01("word", F.lit(c)).alias(f"{c}_p") for c in CATEGORIES]
    cols += [(2 * u01("word", F.lit(c), F.lit("s")) - 1).alias(f"{c}_sent") for c in CATEGORIES]
    return vocab.select("word", *cols)


def word_vectors(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """token -> 64-d vector of ``embeddings`` row ``floor(u01(token) * number of rows)``; 30 % OOV. ``words`` is the
    query's ``vocabulary``, if it has one already."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    size = emb.agg((F.max("vec_id") + 1).alias("_n"))  # one row
    words = vocabulary(spark, sf_dir) if words is None else words
    vocab = words.select("token").where(u01("token", F.lit("oov")) >= 0.3)
    vocab = vocab.crossJoin(F.broadcast(size)).select("token", F.floor(u01("token") * F.col("_n")).cast("long").alias("vec_id"))
    return vocab.join(emb, "vec_id", "inner").select("token", "vec")


def seed_lists(spark: SparkSession, sf_dir: str, per_category: int = 8, words: DataFrame | None = None) -> DataFrame:
    """Top ``per_category`` most frequent in-vocabulary word tokens per category (category by u01)."""
    from pyspark.sql import Window

    words = vocabulary(spark, sf_dir) if words is None else words
    freq = words.where(F.col("token").rlike(r"^\p{L}+$"))
    vocab = word_vectors(spark, sf_dir, words).select("token")
    freq = freq.join(vocab, "token", "left_semi")
    cat = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]),
                       (F.floor(u01("token", F.lit("seed")) * len(CATEGORIES)) + 1).cast("int"))
    freq = freq.withColumn("category", cat)
    w = Window.partitionBy("category").orderBy(F.col("n").desc(), F.col("token"))
    return (freq.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_category)
            .select("category", F.col("token").alias("word")))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annoscope.operators.text import sentence_spans
    return sentence_spans(texts(spark, sf_dir), pattern=SENTENCE_PATTERN)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("document_id"), F.lit(None).cast("string").alias("url"), "text")


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    coders = spark.createDataFrame([(c,) for c in HIGHLIGHT_CODERS], "coder_id int")
    x = d.crossJoin(F.broadcast(coders))  # fixed 5-row fan-out per document
    cat = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]),
                       (F.floor(u01("doc_id", "coder_id") * len(CATEGORIES)) + 1).cast("int"))
    start = 1 + F.floor(u01("doc_id", "coder_id", F.lit("p")) * F.col("n_chars")).cast("int")
    return x.select(
        "coder_id", F.col("doc_id").cast("string").alias("document_id"), cat.alias("assigned_domain"),
        start.alias("_start"), "text",
        (F.lit(1800.0) + F.lit(2400.0) * u01("doc_id", "coder_id", F.lit("d"))).alias("focus_duration"),
    ).select("coder_id", "document_id", "assigned_domain",
             F.expr("substring(text, _start, 40)").alias("content"), "focus_duration")


def reddit_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(text, annotation)``: three annotators per document, 1-2 raw labels each (comma list)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    ann = spark.createDataFrame([(a,) for a in range(3)], "annotator int")
    names = F.array(*[F.lit(k) for k, _ in REDDIT_LABEL_MAP])
    n = len(REDDIT_LABEL_MAP)
    first = F.element_at(names, (F.floor(u01("doc_id", "annotator", F.lit("a")) * n) + 1).cast("int"))
    second = F.element_at(names, (F.floor(u01("doc_id", "annotator", F.lit("b")) * n) + 1).cast("int"))
    two = u01("doc_id", "annotator", F.lit("k")) < 0.3
    x = d.crossJoin(F.broadcast(ann))  # fixed 3-row fan-out per document
    return x.select("doc_id", "annotator", "text",
                    F.when(two, F.concat_ws(",", first, second)).otherwise(first).alias("annotation"))


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary scorer: ``(id, corpus, y, {c}_score)`` with ties on purpose (2 decimals)."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    doc = table(spark, sf_dir, "documents").select("doc_id", "lang")
    j = lab.join(doc, "doc_id", "inner")
    cols = [F.round(0.7 * u01("doc_id", F.lit(c)) + 0.3 * F.col("quality"), 2).alias(f"{c}_score") for c in CATEGORIES]
    return j.select(F.col("doc_id").alias("id"), F.col("lang").alias("corpus"), F.col("quality").alias("y"), *cols)


def scored_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form ``(id, corpus, category, y_true, y_score)``."""
    s = scored_labels(spark, sf_dir)
    return s.select("id", "corpus", F.col("y").alias("y_true"),
                    F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"{c}_score").alias("y_score"))
                                        for c in CATEGORIES])).alias("s")).select(
        "id", "corpus", F.col("s.category").alias("category"), "y_true", F.col("s.y_score").alias("y_score"))


def tristate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, category, label)``: quality, or -1 (not seen) where u01(id‖c‖'seen') < 0.2."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    x = lab.select("doc_id", "quality", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
    return x.select(F.col("doc_id").alias("id"), "category",
                    F.when(u01("doc_id", "category", F.lit("seen")) < 0.2, F.lit(-1))
                    .otherwise(F.col("quality")).alias("label"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, created, retrieved_on, score, topic_1, topic_2, {c}_score)`` from ``part``."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    created = F.timestamp_add("DAY", F.pmod(F.col("p_partkey"), F.lit(1000)),
                              F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"))
    lag_days = F.when(F.pmod(F.col("p_partkey"), F.lit(10)) == 0, F.lit(600)).otherwise(F.lit(POST_WINDOW_DAYS + 1))
    retrieved = F.timestamp_add("DAY", lag_days, created)
    cols = [u01(F.lit("p"), "p_partkey", F.lit(c)).alias(f"{c}_score") for c in CATEGORIES]
    return p.select(F.col("p_partkey").alias("id"), created.alias("created"), retrieved.alias("retrieved_on"),
                    F.col("p_retailprice").alias("score"),
                    F.concat(F.lit("t"), F.pmod("p_partkey", F.lit(7)).cast("string")).alias("topic_1"),
                    F.concat(F.lit("t"), F.pmod(F.floor(F.col("p_partkey") / 7), F.lit(7)).cast("string")).alias("topic_2"),
                    *cols)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                 "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    cid = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                      F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                      F.date_format("l_shipdate", "yyyyMMdd"))
    label = _map_expr(F.concat("l_returnflag", "l_linestatus"), COMMENT_LABELS)
    x = li.select(cid.alias("id"), F.col("l_partkey").alias("parent_id"), F.col("l_shipdate").alias("created"),
                  F.col("l_extendedprice").alias("score"), label.alias("label"))
    return x.select("*", *[u01(F.lit("c"), "id", F.lit(c)).alias(f"{c}_score") for c in CATEGORIES])


def stance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    cols = [F.round(u01("o_orderkey", F.lit(c)), 2).alias(f"{c}_score") for c in CATEGORIES]
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("target"),
                    _map_expr(F.col("o_orderstatus"), STANCE_MAP).alias("stance"), *cols)


def url_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    y = 2000 + F.floor(u01("page_id", F.lit("y")) * 20).cast("int")
    m = 1 + F.floor(u01("page_id", F.lit("m")) * 12).cast("int")
    d = 1 + F.floor(u01("page_id", F.lit("d")) * 28).cast("int")
    suffix = F.concat(F.lit("/"), y.cast("string"), F.lit("/"), m.cast("string"), F.lit("/"), d.cast("string"), F.lit("/"))
    return p.select("page_id", F.when(u01("page_id") < 0.6, F.concat("url", suffix)).otherwise(F.col("url")).alias("url"))


def subword_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, pos, token, score)``: every token of every document; marker where u01 < 0.6."""
    t = tokens(spark, sf_dir)
    tok = F.when(u01("id", "pos") < 0.6, F.concat(F.lit("Ġ"), "token")).otherwise(F.col("token"))
    return t.select("id", "pos", tok.alias("token"), u01("id", "pos", F.lit("s")).alias("score"))


def ml_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, vec, y, ys, fold)``: a binary label, one label per category (one-vs-all), fold 0 = test, 1..10 = train."""
    e = table(spark, sf_dir, "embeddings")
    ys = F.array(*[(F.col("label") % len(CATEGORIES) == k).cast("int") for k in range(len(CATEGORIES))])
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"),
                    (F.col("label") < 5).cast("int").alias("y"), ys.alias("ys"), fold_of("vec_id").alias("fold"))


# The languages that stand for the first four categories of labelled documents.
LABEL_LANGS: tuple[str, ...] = ("en", "de", "fr", "es")


def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, ys, fold)`` of every document: one label per category (its language, the quality label for the last one), a tenth of
    them flipped, so that no category can be told without errors."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    q = table(spark, sf_dir, "labels").select("doc_id", "quality")
    told = [F.col("lang") == x for x in LABEL_LANGS] + [F.col("quality") == 1]
    flip = [u01("doc_id", F.lit(c), F.lit("flip")) < 0.1 for c in CATEGORIES]
    ys = F.array(*[(F.coalesce(t, F.lit(False)) != f).cast("int") for t, f in zip(told, flip)])
    return d.join(q, "doc_id", "left").select(F.col("doc_id").alias("id"), ys.alias("ys"), fold_of("doc_id").alias("fold"))


def fold_of(id_col, n: int = 11):
    """Evaluation split by hash: 0 = test, 1..n-1 = cross-validation folds."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit("fold"))), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(n)).cast("int")


def scored_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, corpus, category, fold, y_true, y_score)``."""
    s = scored_long(spark, sf_dir)
    return s.select("id", "corpus", "category", fold_of("id").alias("fold"), "y_true", "y_score")


def tweets_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tweets with two annotators each: ``(corpus, tweet_id, tweet_text, annotator, annotation)``
    from ``conversations`` (one tweet per turn; 1-2 raw Twitter labels per annotator)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    ann = spark.createDataFrame([(a,) for a in range(2)], "annotator int")
    names = F.array(*[F.lit(k) for k, _ in TWITTER_LABEL_MAP])
    n = len(TWITTER_LABEL_MAP)
    tid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    first = F.element_at(names, (F.floor(u01("conv_id", "turn", "annotator", F.lit("a")) * n) + 1).cast("int"))
    second = F.element_at(names, (F.floor(u01("conv_id", "turn", "annotator", F.lit("b")) * n) + 1).cast("int"))
    two = u01("conv_id", "turn", "annotator", F.lit("k")) < 0.3
    x = c.crossJoin(F.broadcast(ann))  # fixed 2-row fan-out per tweet
    return x.select(F.concat(F.lit("c"), F.pmod("conv_id", F.lit(3)).cast("string")).alias("corpus"), tid.alias("tweet_id"),
                    F.col("text").alias("tweet_text"), "annotator",
                    F.when(two, F.concat_ws(",", first, second)).otherwise(first).alias("annotation"))
