"""Social group: windowed post/comment joins, judgment filter, verdicts, radar table, topic rates,
semi/left joins, top-k posts and the stance cross-tab."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoscope.functions.hashing import u01
from annoscope.operators import social as SO
from annoscope.plans import fixtures as fx, sqlfrag as S
from annoscope.plans.catalog._util import rounded
from annoscope.plans.registry import register
from annoscope.schema import CATEGORIES
from annoscope.session import written

WINDOW = f"INTERVAL {fx.POST_WINDOW_DAYS} DAYS"
WINDOW_SQL = f"INTERVAL {fx.POST_WINDOW_DAYS} DAY"
JUDG = "('YTA', 'NTA', 'ESH', 'NAH')"

# ---------------------------------------------------------------- shared derivations (Spark)


def filtered_posts(spark, sf):
    return SO.judgment_counts(fx.posts(spark, sf), fx.comments(spark, sf), WINDOW, fx.POST_MIN_JUDGMENTS, fx.POST_BALANCE)


def filtered_comments(spark, sf):
    """In-window judgment comments of the filtered posts (with ``post_id``), from the same windowed
    join as ``filtered_posts`` (Spark reuses its exchanges)."""
    return SO.judgment_filter(fx.posts(spark, sf), fx.comments(spark, sf), WINDOW, fx.POST_MIN_JUDGMENTS, fx.POST_BALANCE)[1]


def judged(spark, sf):
    """``(posts, comments)``: the filtered posts' ids and counts and their judgment comments, from one windowed
    join written once; every consumer of a query reads that small table."""
    comments = written(filtered_comments(spark, sf), "judged")
    counts = comments.groupBy("post_id").agg(*[F.count_if(F.col("label") == lab).alias(lab.lower()) for lab in SO.JUDGMENTS])
    return counts.withColumnRenamed("post_id", "id"), comments


def verdicts(spark, sf):
    return SO.top_comment(filtered_comments(spark, sf))


def radar(spark, sf):
    p = fx.posts(spark, sf).join(verdicts(spark, sf).withColumnRenamed("post_id", "id"), "id", "inner")
    resolved = F.when(u01("id", F.lit("rv")) < 0.2, F.lit("NTA")).otherwise(F.col("verdict"))
    p = p.withColumn("resolved_verdict", resolved)
    return SO.verdict_join(p, fx.comments(spark, sf))


# ---------------------------------------------------------------- shared derivations (SQL)

BASE = S.with_(S.POSTS, S.COMMENTS) + f""", ok_posts AS (SELECT * FROM posts WHERE retrieved_on > created + {WINDOW_SQL}),
wc_all AS (
  SELECT c.*, p.id AS post_id FROM comments c JOIN ok_posts p ON c.parent_id = p.id AND c.created <= p.created + {WINDOW_SQL}
  WHERE c.label IN {JUDG}
), cnt AS (
  SELECT post_id, count_if(label = 'YTA') AS yta, count_if(label = 'NTA') AS nta, count_if(label = 'ESH') AS esh,
         count_if(label = 'NAH') AS nah FROM wc_all GROUP BY post_id
), fposts AS (
  SELECT post_id AS id, yta, nta, esh, nah FROM cnt
  WHERE yta + nta + esh + nah >= {fx.POST_MIN_JUDGMENTS} AND nta + nah < {fx.POST_BALANCE} * (yta + nta + esh + nah)
    AND yta + esh < {fx.POST_BALANCE} * (yta + nta + esh + nah)
), fcomments AS (SELECT * FROM wc_all WHERE post_id IN (SELECT id FROM fposts)),
verdicts AS (
  SELECT post_id, arg_min(id, (-score, id)) AS verdict_id, arg_min(label, (-score, id)) AS verdict, max(score) AS verdict_score
  FROM fcomments GROUP BY post_id
), vposts AS (
  SELECT p.*, v.verdict_id, CASE WHEN {S.u01('p.id', S.q('rv'))} < 0.2 THEN 'NTA' ELSE v.verdict END AS resolved_verdict
  FROM posts p JOIN verdicts v ON v.post_id = p.id
), radar AS (
  SELECT p.id, p.topic_1, p.topic_2, c.label AS verdict, c.id AS verdict_id, p.score, coalesce(c.score, 0.0) AS verdict_score,
         {', '.join(f'p.{c}_score' for c in CATEGORIES)}, {', '.join(f'c.{c}_score AS v_{c}_score' for c in CATEGORIES)},
         CAST(coalesce(c.label IN ('YTA', 'ESH'), false) AS INTEGER) AS YA, CAST(coalesce(c.label IN ('NTA', 'NAH'), false) AS INTEGER) AS NA
  FROM vposts p LEFT JOIN comments c ON p.verdict_id = c.id AND p.resolved_verdict = c.label
)
"""


@register("aita_filter", "social", sql=BASE + "SELECT id, yta, nta, esh, nah FROM fposts")
def aita_filter(spark, sf):
    return filtered_posts(spark, sf)


@register("top_verdict", "social", sql=BASE + "SELECT post_id, verdict_id, verdict, round(verdict_score, 6) AS verdict_score FROM verdicts")
def top_verdict(spark, sf):
    return rounded(verdicts(spark, sf))


_RADAR_COLS = ["id", "topic_1", "topic_2", "verdict", "verdict_id", "score", "verdict_score"] + \
    [f"{c}_score" for c in CATEGORIES] + [f"v_{c}_score" for c in CATEGORIES] + ["YA", "NA"]


@register("aita_verdict_join", "social", sql=BASE + "SELECT " + ", ".join(
    (f"round({c}, 6) AS {c}" if c.endswith("score") else c) for c in _RADAR_COLS) + " FROM radar")
def aita_verdict_join(spark, sf):
    return rounded(radar(spark, sf).select(*_RADAR_COLS))


@register("join_semi", "social", sql=S.with_(S.POSTS, S.COMMENTS) + f"""SELECT c.id, c.parent_id FROM comments c
WHERE c.parent_id IN (SELECT id FROM posts WHERE {S.u01('id', S.q('scored'))} < 0.8)""")
def join_semi(spark, sf):
    scored = fx.posts(spark, sf).where(u01("id", F.lit("scored")) < 0.8).select(F.col("id").alias("_post"))
    comments = fx.comments(spark, sf)
    return comments.join(scored, F.col("parent_id") == F.col("_post"), "left_semi").select("id", "parent_id")


# ---------------------------------------------------------------- arguments: left join + dedup

_ARG_CHOICES = list(CATEGORIES) + [None]


def arguments(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("arg_id"), "p_name")
    arr = F.array(*[F.lit(c) for c in _ARG_CHOICES])

    def pick(tag):
        return F.element_at(arr, (F.floor(u01("arg_id", F.lit(tag)) * len(_ARG_CHOICES)) + 1).cast("int"))
    return p.select("arg_id", F.col("p_name").alias("argument"), pick("MF1").alias("MF1"), pick("MF2").alias("MF2"),
                    pick("MF3").alias("MF3"))


def _sql_pick(tag):
    arr = "[" + ", ".join(S.q(c) for c in _ARG_CHOICES) + "]"
    return f"{arr}[CAST(floor({S.u01('p_partkey', S.q(tag))} * {len(_ARG_CHOICES)}) AS INTEGER) + 1]"


ARGS_SQL = f"""args AS (SELECT p_partkey AS arg_id, p_name AS argument, {_sql_pick('MF1')} AS MF1, {_sql_pick('MF2')} AS MF2,
  {_sql_pick('MF3')} AS MF3 FROM part)"""


@register("join_left_dedup", "social", sql=S.with_(ARGS_SQL) + f"""SELECT DISTINCT t.argument, a.MF1, a.MF2, a.MF3
FROM (SELECT arg_id, argument FROM args) t
LEFT JOIN (SELECT arg_id, MF1, MF2, MF3 FROM args WHERE {S.u01('arg_id', S.q('labelled'))} < 0.7) a ON a.arg_id = t.arg_id""")
def join_left_dedup(spark, sf):
    a = arguments(spark, sf)
    texts = a.select("arg_id", "argument")
    # about 30 % of the arguments have no annotation, so the left join keeps NULL labels
    labels = a.where(u01("arg_id", F.lit("labelled")) < 0.7).select("arg_id", "MF1", "MF2", "MF3")
    return texts.join(labels, "arg_id", "left").dropDuplicates(["argument", "MF1", "MF2", "MF3"]) \
        .select("argument", "MF1", "MF2", "MF3")


# ---------------------------------------------------------------- topic rates

def _flags_sql():
    return " UNION ALL ".join(
        f"SELECT topic_1, topic_2, CASE WHEN YA = 1 THEN 'YA' WHEN NA = 1 THEN 'NA' END AS side, '{c}' AS category, "
        f"CAST({c}_score >= 0.5 AS INTEGER) AS post_flag, CAST(v_{c}_score >= 0.5 AS INTEGER) AS verdict_flag FROM radar"
        for c in CATEGORIES)


@register("topic_rates", "social", sql=BASE + f""", lf AS (SELECT * FROM ({_flags_sql()}) WHERE side IS NOT NULL)
SELECT topic_1 AS topic, side, category, count(*) AS n, round(avg(post_flag), 6) AS post_rate, round(avg(verdict_flag), 6) AS verdict_rate
FROM lf GROUP BY ALL""")
def topic_rates(spark, sf):
    return rounded(SO.topic_rates(radar(spark, sf)))


@register("topic_pair_rates", "social", sql=BASE + f""", lf AS (SELECT * FROM ({_flags_sql()}) WHERE side IS NOT NULL),
rates AS (SELECT least(topic_1, topic_2) AS topic_a, greatest(topic_1, topic_2) AS topic_b, side, category, count(*) AS n,
                 avg(post_flag) AS post_rate, avg(verdict_flag) AS verdict_rate FROM lf GROUP BY ALL),
topics AS (SELECT topic_1 AS t FROM radar UNION SELECT topic_2 FROM radar),
spine AS (SELECT a.t AS topic_a, b.t AS topic_b, d.side, d.category FROM topics a JOIN topics b ON a.t < b.t
          CROSS JOIN (SELECT DISTINCT side, category FROM lf) d)
SELECT s.topic_a, s.topic_b, s.side, s.category, coalesce(r.n, 0) AS n, round(coalesce(r.post_rate, 0.0), 6) AS post_rate,
       round(coalesce(r.verdict_rate, 0.0), 6) AS verdict_rate
FROM spine s LEFT JOIN rates r USING (topic_a, topic_b, side, category)""")
def topic_pair_rates(spark, sf):
    return rounded(SO.topic_pair_rates(radar(spark, sf)))


# ---------------------------------------------------------------- top-k posts with exactly three categories

@register("topk_posts", "social", sql=S.with_(S.POSTS) + f"""SELECT id, round(score, 6) AS score, n_categories FROM (
  SELECT id, score, {' + '.join(f'CAST({c}_score >= 0.5 AS INTEGER)' for c in CATEGORIES)} AS n_categories FROM posts
) WHERE n_categories = 3 ORDER BY score DESC, id LIMIT 15""")
def topk_posts(spark, sf, k: int = 15):
    p = fx.posts(spark, sf)
    n = sum((F.col(f"{c}_score") >= 0.5).cast("int") for c in CATEGORIES)
    return rounded(p.select("id", "score", n.alias("n_categories")).where(F.col("n_categories") == 3)
                   .orderBy(F.col("score").desc(), "id").limit(k))


# ---------------------------------------------------------------- cross-tab with totals

_STANCES = ("AGAINST", "FAVOR", "NONE")


@register("crosstab_totals", "social", sql=S.with_(S.STANCE) + f"""SELECT coalesce(target, 'Total') AS target,
  {', '.join(f"count_if(stance = '{s}') AS {s}" for s in _STANCES)}, count(*) AS Total
FROM stance GROUP BY ROLLUP (target)""")
def crosstab_totals(spark, sf):
    st = fx.stance(spark, sf)
    c = st.cube("target", "stance").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    c = c.withColumn("target", F.when(F.col("gid").bitwiseAND(2) == 2, F.lit("Total")).otherwise(F.col("target"))) \
        .withColumn("stance", F.when(F.col("gid").bitwiseAND(1) == 1, F.lit("Total")).otherwise(F.col("stance")))
    wide = c.groupBy("target").pivot("stance", list(_STANCES) + ["Total"]).agg(F.first("n"))
    return wide.select("target", *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in _STANCES], "Total")
