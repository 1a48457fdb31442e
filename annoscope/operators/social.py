"""Posts × comments analysis.

The per-post database lookups of the reference become joins: one equi-join on the post id with
the time window as a residual predicate, grouped aggregations with map-side combine, and
``min_by``/``max_by`` aggregates (not sorted windows) for "the top comment of each post", so a
post with a third of all comments is reduced in partial aggregates before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from annoscope.schema import CATEGORIES

# The judgment labels and the two sides they form.
JUDGMENTS: tuple[str, ...] = ("YTA", "NTA", "ESH", "NAH")
YA_LABELS: tuple[str, ...] = ("YTA", "ESH")
NA_LABELS: tuple[str, ...] = ("NTA", "NAH")


def window_comments(posts: DataFrame, comments: DataFrame, window_expr: str, labels: Sequence[str] = JUDGMENTS) -> DataFrame:
    """Judgment comments of each post created at most ``window`` after the post.

    Equi-join ``parent_id = id`` plus the residual ``c.created - p.created <= window`` (earlier
    comments, negative gaps, are kept). ``window_expr`` is a SQL interval, e.g. ``INTERVAL 18 HOURS``.
    The label filter is pushed to the comment scan.
    """
    p = posts.select(F.col("id").alias("post_id"), F.col("created").alias("post_created"))
    c = comments.where(F.col("label").isin(list(labels)))
    cond = (c["parent_id"] == p["post_id"]) & (c["created"] <= p["post_created"] + F.expr(window_expr))
    return c.join(p, cond, "inner")


def judgment_filter(posts: DataFrame, comments: DataFrame, window_expr: str, min_total: int,
                    balance: float) -> tuple[DataFrame, DataFrame]:
    """G6 + F5: posts retrieved more than ``window`` after creation whose in-window judgments number
    at least ``min_total`` and neither side reaches ``balance`` of them, and those posts' in-window
    judgment comments. Both come from one windowed join: ``(id, yta, nta, esh, nah)`` and the
    comments with ``post_id``."""
    ok_posts = posts.where(F.col("retrieved_on") > F.col("created") + F.expr(window_expr))
    wc = window_comments(ok_posts, comments, window_expr)
    counts = wc.groupBy("post_id").agg(*[F.count_if(F.col("label") == lab).alias(lab.lower()) for lab in JUDGMENTS])
    na = F.col("nta") + F.col("nah")
    ya = F.col("yta") + F.col("esh")
    tot = na + ya
    kept = (counts.where((tot >= min_total) & (na < balance * tot) & (ya < balance * tot))
            .select(F.col("post_id").alias("id"), "yta", "nta", "esh", "nah"))
    kept_comments = wc.join(kept.select(F.col("id").alias("post_id")), "post_id", "left_semi")
    return kept, kept_comments


def judgment_counts(posts: DataFrame, comments: DataFrame, window_expr: str, min_total: int, balance: float) -> DataFrame:
    """The filtered posts of ``judgment_filter``."""
    return judgment_filter(posts, comments, window_expr, min_total, balance)[0]


def top_comment(comments: DataFrame, post_col: str = "post_id", keep: Sequence[str] = ()) -> DataFrame:
    """H1: highest-scored comment per post; ties -> smallest comment id (a deterministic choice). ``keep`` names
    further columns of that comment to carry along, so that it need not be looked up again.

    ``min_by(…, struct(-score, id))`` is an aggregate with partial aggregation, so no post's
    comments are ever sorted or gathered in one task."""
    key = F.struct(-F.col("score"), F.col("id"))
    return comments.groupBy(post_col).agg(
        F.min_by("id", key).alias("verdict_id"), F.min_by("label", key).alias("verdict"),
        F.max("score").alias("verdict_score"), *[F.min_by(c, key).alias(c) for c in keep])


def verdict_join(posts: DataFrame, comments: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Posts ⟕ their verdict comment on ``verdict_id = id AND label = resolved_verdict``;
    unmatched posts keep NULL verdict fields and score 0. Adds post ``{c}_score``, verdict
    ``v_{c}_score`` and the side flags YA / NA."""
    vc = comments.select(F.col("id").alias("_vid"), F.col("label").alias("_vlabel"), F.col("score").alias("_vscore"),
                         *[F.col(f"{c}_score").alias(f"v_{c}_score") for c in categories])
    cond = (posts["verdict_id"] == vc["_vid"]) & (posts["resolved_verdict"] == vc["_vlabel"])
    j = posts.join(vc, cond, "left")
    return j.select("id", "topic_1", "topic_2", F.col("_vlabel").alias("verdict"), F.col("_vid").alias("verdict_id"),
                    "score", F.coalesce(F.col("_vscore"), F.lit(0.0)).alias("verdict_score"),
                    *[f"{c}_score" for c in categories], *[f"v_{c}_score" for c in categories],
                    F.coalesce(F.col("_vlabel").isin(list(YA_LABELS)), F.lit(False)).cast("int").alias("YA"),
                    F.coalesce(F.col("_vlabel").isin(list(NA_LABELS)), F.lit(False)).cast("int").alias("NA"))


def _long_flags(radar: DataFrame, categories: Sequence[str], threshold: float) -> DataFrame:
    side = F.when(F.col("YA") == 1, "YA").when(F.col("NA") == 1, "NA")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("category"),
                                        (F.col(f"{c}_score") >= threshold).cast("int").alias("post_flag"),
                                        (F.col(f"v_{c}_score") >= threshold).cast("int").alias("verdict_flag"))
                               for c in categories]))
    return radar.select("topic_1", "topic_2", side.alias("side"), rows.alias("r")) \
        .select("topic_1", "topic_2", "side", "r.category", "r.post_flag", "r.verdict_flag")


def topic_rates(radar: DataFrame, categories: Sequence[str] = CATEGORIES, threshold: float = 0.5) -> DataFrame:
    """Share of posts / verdicts with each category, by (topic_1, side); one grouped pass."""
    lf = _long_flags(radar, categories, threshold).where(F.col("side").isNotNull())
    return lf.groupBy(F.col("topic_1").alias("topic"), "side", "category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("post_flag").alias("post_rate"), F.avg("verdict_flag").alias("verdict_rate"))


def topic_pair_rates(radar: DataFrame, categories: Sequence[str] = CATEGORIES, threshold: float = 0.5) -> DataFrame:
    """Rates by *unordered* topic pair and side; pairs with no post get rate 0.

    Data rows are read and aggregated once, into a written table. The spine (topic pairs x < y × sides × categories)
    is the answer's own shape and comes from that small table; data rows are never paired."""
    from annoscope.session import written

    lf = _long_flags(radar, categories, threshold)
    t1, t2 = F.least("topic_1", "topic_2"), F.greatest("topic_1", "topic_2")
    every = written(lf.groupBy(t1.alias("topic_a"), t2.alias("topic_b"), "side", "category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("post_flag").alias("post_rate"), F.avg("verdict_flag").alias("verdict_rate")), "topic_rates")
    rates = every.where(F.col("side").isNotNull())
    topics = every.select(F.col("topic_a").alias("t")).union(every.select(F.col("topic_b").alias("t"))).distinct()
    pairs = topics.select(F.col("t").alias("topic_a")).join(topics.select(F.col("t").alias("topic_b")), F.col("topic_a") < F.col("topic_b"))
    spine = pairs.crossJoin(rates.select("side", "category").distinct())
    j = spine.join(rates, ["topic_a", "topic_b", "side", "category"], "left")
    return j.select("topic_a", "topic_b", "side", "category", F.coalesce("n", F.lit(0)).alias("n"),
                    F.coalesce("post_rate", F.lit(0.0)).alias("post_rate"),
                    F.coalesce("verdict_rate", F.lit(0.0)).alias("verdict_rate"))
