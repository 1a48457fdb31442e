"""Stats group: contingency tables, odds ratios (single, 5×5 matrix, per post), conditional
probabilities, χ², Mann–Whitney, t-test and group medians.

p-values need the normal / t / χ² tails, which DuckDB lacks; where a p-value only decides a
significance mark, the oracle uses the equivalent critical value of the statistic instead.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from annoscope.operators import social as SO, stats as ST
from annoscope.operators.prefix import exact_percentiles
from annoscope.operators.threshold import percentile_threshold
from annoscope.plans import fixtures as fx, sqlfrag as S
from annoscope.plans.catalog import social as SC
from annoscope.plans.catalog._util import rounded
from annoscope.plans.registry import register
from annoscope.schema import CATEGORIES
from annoscope.session import written

Z_975 = 1.959963984540054          # normal 0.975 quantile (95 % two-sided)
# χ² (1 df) critical values for p = .001, .01, .05.
CHI2_CRIT = ((10.827566170662733, "***"), (6.6348966010212145, "**"), (3.841458820694124, "*"))
LEVEL = 80


# ---------------------------------------------------------------- stance tables

def stance_long(spark, sf):
    """Stance rows without NONE, one row per category, with the strict top-20 % prediction
    (``score > 80th percentile`` of that category over those rows)."""
    st = fx.stance(spark, sf).where(F.col("stance") != "NONE")
    long = st.select("id", "target", "stance", F.explode(F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(f"{c}_score").alias("score")) for c in CATEGORIES])).alias("r")) \
        .select("id", "target", "stance", "r.category", "r.score")
    thr = percentile_threshold(long, ["category"], "score", LEVEL)
    return long.join(thr, "category").select(
        "id", "target", "stance", "category", "score", (F.col("stance") == "FAVOR").cast("int").alias("favor"),
        (F.col("score") > F.col("threshold")).cast("int").alias("pred"))


STANCE_SQL = S.with_(S.STANCE) + ", st_long AS (" + " UNION ALL ".join(
    f"SELECT id, target, stance, '{c}' AS category, {c}_score AS score FROM stance WHERE stance <> 'NONE'" for c in CATEGORIES
) + f"""), thr AS (SELECT category, quantile_cont(score, {LEVEL / 100}) AS threshold FROM st_long GROUP BY category),
sl AS (SELECT l.*, CAST(stance = 'FAVOR' AS INTEGER) AS favor, CAST(score > t.threshold AS INTEGER) AS pred
       FROM st_long l JOIN thr t USING (category)),
ct AS (SELECT target, category, count_if(favor = 0 AND pred = 0) AS n00, count_if(favor = 0 AND pred = 1) AS n01,
              count_if(favor = 1 AND pred = 0) AS n10, count_if(favor = 1 AND pred = 1) AS n11 FROM sl GROUP BY ALL)
"""


def _stance_table(spark, sf):
    return ST.contingency(stance_long(spark, sf), ["target", "category"], "favor", "pred")


@register("stat_contingency", "stats", sql=STANCE_SQL + "SELECT target, category, n00, n01, n10, n11 FROM ct")
def stat_contingency(spark, sf):
    return _stance_table(spark, sf)


def _or_sql(src: str, keys: str) -> str:
    nz = "n00 > 0 AND n01 > 0 AND n10 > 0 AND n11 > 0"
    se = "sqrt(1.0 / n00 + 1.0 / n01 + 1.0 / n10 + 1.0 / n11)"
    lor = "ln((n11 * n00) / (n10 * n01))"
    return f"""SELECT {keys}, n00, n01, n10, n11,
  round(CASE WHEN {nz} THEN (n11 * n00) / (n10 * n01) END, 6) AS odds_ratio,
  round(CASE WHEN {nz} THEN {lor} END, 6) AS log_or, round(CASE WHEN {nz} THEN {se} END, 6) AS se,
  round(CASE WHEN {nz} THEN exp({lor} - {Z_975} * {se}) END, 6) AS ci_lower,
  round(CASE WHEN {nz} THEN exp({lor} + {Z_975} * {se}) END, 6) AS ci_upper,
  round(CASE WHEN {nz} THEN abs({lor}) / {se} END, 6) AS z
FROM {src}"""


_OR_COLS = ["n00", "n01", "n10", "n11", "odds_ratio", "log_or", "se", "ci_lower", "ci_upper", "z"]


@register("stat_or", "stats", sql=STANCE_SQL + _or_sql("ct", "target, category"))
def stat_or(spark, sf):
    return rounded(ST.odds_ratio(_stance_table(spark, sf), with_p=False).select("target", "category", *_OR_COLS))


@register("stat_chi2", "stats", sql=STANCE_SQL + f""", x AS (
  SELECT target, category, CASE WHEN (n00 + n01) * (n10 + n11) * (n00 + n10) * (n01 + n11) > 0 THEN
    (n00 + n01 + n10 + n11) * pow(n00 * n11 - n01 * n10, 2) / ((n00 + n01) * (n10 + n11) * (n00 + n10) * (n01 + n11)) END AS chi2 FROM ct
)
SELECT target, category, round(chi2, 6) AS chi2,
  CASE {' '.join(f"WHEN chi2 > {v} THEN '{m}'" for v, m in CHI2_CRIT)} ELSE '-' END AS stars FROM x""")
def stat_chi2(spark, sf):
    return rounded(ST.chi2_2x2(_stance_table(spark, sf)).select("target", "category", "chi2", "stars"))


# ---------------------------------------------------------------- Mann–Whitney and medians

@register("stat_mwu", "stats", sql=STANCE_SQL + f""", r AS (
  SELECT target, category, favor, score,
         rank() OVER (PARTITION BY target, category ORDER BY score) + (count(*) OVER (PARTITION BY target, category, score) - 1) / 2.0 AS rk
  FROM sl
), ties AS (
  SELECT target, category, sum(pow(c, 3) - c) AS t FROM (SELECT target, category, score, count(*) AS c FROM sl GROUP BY ALL) GROUP BY ALL
), a AS (
  SELECT target, category, sum(CASE WHEN favor = 1 THEN rk ELSE 0 END) AS R1, count_if(favor = 1) AS n1, count(*) AS n,
         median(CASE WHEN favor = 1 THEN score END) AS median1, median(CASE WHEN favor = 0 THEN score END) AS median2
  FROM r GROUP BY ALL
), u AS (
  SELECT a.*, R1 - n1 * (n1 + 1) / 2.0 AS U, n1 * (n - n1) / 2.0 AS mu,
         sqrt(n1 * (n - n1) / 12.0 * ((n + 1) - t.t / (n * (n - 1.0)))) AS sigma
  FROM a JOIN ties t USING (target, category)
)
SELECT target, category, n1, n - n1 AS n2, round(U, 6) AS U, round((greatest(U, n1 * (n - n1) - U) - mu - 0.5) / sigma, 6) AS z,
  round(median1, 6) AS median1, round(median2, 6) AS median2,
  CASE WHEN (greatest(U, n1 * (n - n1) - U) - mu - 0.5) / sigma > {Z_975}
       THEN CASE WHEN median1 > median2 THEN 'FAVOR' ELSE 'AGAINST' END ELSE '-' END AS winner
FROM u""")
def stat_mwu(spark, sf):
    r = ST.mann_whitney(stance_long(spark, sf), ["target", "category"], "score", "favor")
    winner = F.when(F.col("p_value") < 0.05, F.when(F.col("median1") > F.col("median2"), "FAVOR").otherwise("AGAINST")).otherwise("-")
    return rounded(r.select("target", "category", "n1", "n2", "U", "z", "median1", "median2", winner.alias("winner")))


@register("group_median", "stats", sql=S.with_(S.STANCE) + ", l AS (" + " UNION ALL ".join(
    f"SELECT target, stance, '{c}' AS category, {c}_score AS score FROM stance" for c in CATEGORIES)
    + ") SELECT target, category, stance, round(median(score), 6) AS median FROM l GROUP BY ALL")
def group_median(spark, sf):
    st = fx.stance(spark, sf)
    long = st.select("target", "stance", F.explode(F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(f"{c}_score").alias("score")) for c in CATEGORIES])).alias("r")) \
        .select("target", "stance", "r.category", "r.score")
    med = exact_percentiles(long, ["target", "category", "stance"], "score", probs=[0.5], out_col="median")
    return rounded(med.drop("prob"))


# ---------------------------------------------------------------- posts × verdicts (5×5)

def category_thresholds(df, level: float, prefix: str, categories=CATEGORIES):
    """One-row table ``{prefix}{c}`` = the ``level``-th percentile of ``{c}_score``: the wide
    scores are unpivoted once and all categories go through one grouped exact selection."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"{c}_score").alias("s"))
                                         for c in categories])).alias("r")).select("r.category", "r.s")
    t = percentile_threshold(long, ["category"], "s", level)
    return t.groupBy().pivot("category", list(categories)).agg(F.first("threshold")) \
        .select(*[F.col(c).alias(f"{prefix}{c}") for c in categories])


def _flagged(spark, sf):
    """Filtered posts and their verdict comments with top-20 % flags (``>=`` the 80th percentile,
    posts against posts, verdicts against all filtered comments)."""
    kept, comments = SC.judged(spark, sf)
    posts = written(fx.posts(spark, sf).join(kept.select("id"), "id", "left_semi"), "judged_posts")
    thr = category_thresholds(posts, LEVEL, "pt_").crossJoin(category_thresholds(comments, LEVEL, "ct_"))  # 1 row × 1 row
    v = SO.top_comment(comments, keep=[f"{c}_score" for c in CATEGORIES])
    j = posts.join(v.select(F.col("post_id").alias("id"), *[F.col(f"{c}_score").alias(f"v_{c}") for c in CATEGORIES]), "id")
    j = j.crossJoin(F.broadcast(thr))
    return j.select("id", *[(F.col(f"{c}_score") >= F.col(f"pt_{c}")).cast("int").alias(f"p_{c}") for c in CATEGORIES],
                    *[(F.col(f"v_{c}") >= F.col(f"ct_{c}")).cast("int").alias(f"vf_{c}") for c in CATEGORIES])


def _matrix(spark, sf):
    """25 contingency tables in one global aggregation (no explode, no per-pair pass)."""
    f = _flagged(spark, sf)
    aggs = []
    for a in CATEGORIES:
        for b in CATEGORIES:
            for i in (0, 1):
                for j in (0, 1):
                    aggs.append(F.count_if((F.col(f"p_{a}") == i) & (F.col(f"vf_{b}") == j)).alias(f"{a}|{b}|n{i}{j}"))
    wide = f.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("post_f"), F.lit(b).alias("verdict_f"),
                                        *[F.col(f"`{a}|{b}|n{i}{j}`").alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)])
                               for a in CATEGORIES for b in CATEGORIES]))
    return wide.select(rows.alias("r")).select("r.*")


MATRIX_SQL = SC.BASE + ", pq AS (SELECT " + ", ".join(
    f"quantile_cont({c}_score, {LEVEL / 100}) AS pt_{c}" for c in CATEGORIES) + " FROM posts WHERE id IN (SELECT id FROM fposts)), cq AS (SELECT " + ", ".join(
    f"quantile_cont({c}_score, {LEVEL / 100}) AS ct_{c}" for c in CATEGORIES) + """ FROM fcomments),
fl AS (
  SELECT p.id, """ + ", ".join(f"CAST(p.{c}_score >= pq.pt_{c} AS INTEGER) AS p_{c}" for c in CATEGORIES) + ", " + ", ".join(
    f"CAST(c.{c}_score >= cq.ct_{c} AS INTEGER) AS vf_{c}" for c in CATEGORIES) + """
  FROM posts p JOIN verdicts v ON v.post_id = p.id JOIN fcomments c ON c.id = v.verdict_id CROSS JOIN pq CROSS JOIN cq
), m AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS post_f, '{b}' AS verdict_f, count_if(p_{a} = 0 AND vf_{b} = 0) AS n00, count_if(p_{a} = 0 AND vf_{b} = 1) AS n01, "
    f"count_if(p_{a} = 1 AND vf_{b} = 0) AS n10, count_if(p_{a} = 1 AND vf_{b} = 1) AS n11 FROM fl"
    for a in CATEGORIES for b in CATEGORIES) + ")\n"


_SIG = (f"CASE WHEN n00 > 0 AND n01 > 0 AND n10 > 0 AND n11 > 0 AND abs(ln((n11 * n00) / (n10 * n01))) / "
        f"sqrt(1.0 / n00 + 1.0 / n01 + 1.0 / n10 + 1.0 / n11) > {Z_975} THEN 1 ELSE 0 END")


@register("stat_or_matrix", "stats", sql=MATRIX_SQL + f"SELECT o.*, {_SIG} AS significant FROM ({_or_sql('m', 'post_f, verdict_f')}) o")
def stat_or_matrix(spark, sf):
    o = ST.odds_ratio(_matrix(spark, sf))
    o = o.withColumn("significant", F.coalesce((F.col("p_value") < 0.05).cast("int"), F.lit(0)))
    return rounded(o.select("post_f", "verdict_f", *_OR_COLS, "significant"))


@register("stat_condprob", "stats", sql=MATRIX_SQL + """SELECT post_f, verdict_f,
  round(CASE WHEN n10 + n11 > 0 THEN n11 / (n10 + n11) END, 6) AS cond_prob FROM m""")
def stat_condprob(spark, sf):
    return rounded(ST.conditional_prob(_matrix(spark, sf)).select("post_f", "verdict_f", "cond_prob"))


# ---------------------------------------------------------------- per post: comment side × category

def _comment_flags(c):
    c = c.crossJoin(F.broadcast(category_thresholds(c, LEVEL, "ct_")))  # one-row table
    side = F.col("label").isin("YTA", "ESH").cast("int")
    return c.select("post_id", side.alias("ya"), F.explode(F.array(*[
        F.struct(F.lit(cat).alias("category"), (F.col(f"{cat}_score") >= F.col(f"ct_{cat}")).cast("int").alias("flag"))
        for cat in CATEGORIES])).alias("r")).select("post_id", "ya", "r.category", "r.flag")


def _post_counts(c):
    """``(post_id, category, n00, n01, n10, n11, nf)``: the categories of a post are counted side by side, one row a post in the shuffle."""
    c = c.crossJoin(F.broadcast(category_thresholds(c, LEVEL, "ct_")))  # one-row table
    c = c.select("post_id", F.col("label").isin("YTA", "ESH").cast("int").alias("ya"),
                 *[(F.col(f"{cat}_score") >= F.col(f"ct_{cat}")).cast("int").alias(cat) for cat in CATEGORIES])
    aggs = [F.count_if((F.col("ya") == i) & (F.col(cat) == j)).alias(f"{cat}|n{i}{j}") for cat in CATEGORIES for i in (0, 1) for j in (0, 1)]
    wide = c.groupBy("post_id").agg(*aggs, *[F.sum(cat).alias(f"{cat}|nf") for cat in CATEGORIES])
    names = ("n00", "n01", "n10", "n11", "nf")
    rows = F.explode(F.array(*[F.struct(F.lit(cat).alias("category"), *[F.col(f"`{cat}|{n}`").alias(n) for n in names]) for cat in CATEGORIES]))
    return wide.select("post_id", rows.alias("r")).select("post_id", "r.*")


_COMMENT_FLAGS_SQL = SC.BASE + ", cq AS (SELECT " + ", ".join(
    f"quantile_cont({c}_score, {LEVEL / 100}) AS ct_{c}" for c in CATEGORIES) + " FROM fcomments), cf AS (" + " UNION ALL ".join(
    f"SELECT post_id, CAST(label IN ('YTA', 'ESH') AS INTEGER) AS ya, '{c}' AS category, CAST({c}_score >= cq.ct_{c} AS INTEGER) AS flag "
    f"FROM fcomments CROSS JOIN cq" for c in CATEGORIES) + ")\n"


@register("stat_or_per_post", "stats", sql=_COMMENT_FLAGS_SQL + f""", t AS (
  SELECT post_id, category, count_if(ya = 0 AND flag = 0) AS n00, count_if(ya = 0 AND flag = 1) AS n01,
         count_if(ya = 1 AND flag = 0) AS n10, count_if(ya = 1 AND flag = 1) AS n11, sum(flag) AS nf FROM cf GROUP BY ALL
), o AS (
  SELECT post_id, (n11 * n00) / (n10 * n01) AS odds_ratio,
         abs(ln((n11 * n00) / (n10 * n01))) / sqrt(1.0 / n00 + 1.0 / n01 + 1.0 / n10 + 1.0 / n11) AS z
  FROM t WHERE nf > 0 AND n00 > 0 AND n01 > 0 AND n10 > 0 AND n11 > 0
), pp AS (
  SELECT post_id, count_if(z > {Z_975} AND odds_ratio > 1) AS gt1, count_if(z > {Z_975} AND odds_ratio <= 1) AS lt1 FROM o GROUP BY post_id
)
SELECT (SELECT count(*) FROM fposts) AS n_posts, count_if(gt1 * lt1 > 0) AS n_both,
       round(count_if(gt1 * lt1 > 0) / (SELECT count(*) FROM fposts), 6) AS share FROM pp""")
def stat_or_per_post(spark, sf):
    kept, comments = SC.judged(spark, sf)
    t = _post_counts(comments)
    t = t.where((F.col("nf") > 0) & (F.col("n00") > 0) & (F.col("n01") > 0) & (F.col("n10") > 0) & (F.col("n11") > 0))
    o = ST.odds_ratio(t, with_p=False)
    sig = F.col("z") > F.lit(Z_975)  # two-sided p < 0.05, as a plain column: these are many rows
    pp = o.groupBy("post_id").agg(F.count_if(sig & (F.col("odds_ratio") > 1)).alias("gt1"),
                                  F.count_if(sig & (F.col("odds_ratio") <= 1)).alias("lt1"))
    n_posts = kept.agg(F.count(F.lit(1)).alias("n_posts"))
    both = pp.agg(F.count_if(F.col("gt1") * F.col("lt1") > 0).alias("n_both"))
    return rounded(n_posts.crossJoin(both).withColumn("share", F.col("n_both") / F.col("n_posts")))


@register("stat_ttest", "stats", sql=_COMMENT_FLAGS_SQL + """, a AS (
  SELECT post_id, category, count_if(ya = 1) AS n1, count_if(ya = 0) AS n2, avg(CASE WHEN ya = 1 THEN flag END) AS mean1,
         avg(CASE WHEN ya = 0 THEN flag END) AS mean2, var_samp(CASE WHEN ya = 1 THEN flag END) AS v1,
         var_samp(CASE WHEN ya = 0 THEN flag END) AS v2 FROM cf GROUP BY ALL
)
SELECT post_id, category, n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2,
  round(CASE WHEN ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2) > 0 THEN
    (mean1 - mean2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) END, 6) AS t,
  CAST(n1 + n2 - 2 AS DOUBLE) AS df
FROM a""")
def stat_ttest(spark, sf):
    f = _comment_flags(SC.judged(spark, sf)[1])
    r = ST.ttest_ind(f, ["post_id", "category"], "flag", "ya", with_p=False)
    return rounded(r.withColumn("t", F.when(F.col("t").isNotNull() & ~F.isnan("t"), F.col("t"))))
