"""Thresholds and calibration group."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoscope.operators import calibrate as K, curves as C, threshold as T
from annoscope.plans import fixtures as fx, sqlfrag as S
from annoscope.plans.catalog._util import rounded
from annoscope.plans.registry import register
from annoscope.schema import CATEGORIES

W = S.with_(S.SCORED_FOLDS)
G1 = ["category"]


@register("binarize", "thresholds", sql=W + """SELECT id, category, y_score, CAST(y_score >= 0.5 AS INTEGER) AS pred_ge,
  CAST(y_score > 0.5 AS INTEGER) AS pred_gt FROM scored_folds""")
def binarize(spark, sf):
    from annoscope.functions.predicates import binarize as bz
    s = fx.scored_folds(spark, sf)
    return s.select("id", "category", "y_score", bz("y_score", 0.5).alias("pred_ge"), bz("y_score", 0.5, strict=True).alias("pred_gt"))


@register("thr_percentile", "thresholds", sql=W + """, t AS (SELECT category, quantile_cont(y_score, 0.9) AS threshold FROM scored_folds GROUP BY category)
SELECT s.category, round(t.threshold, 6) AS threshold, count_if(s.y_score >= t.threshold) AS n_ge, count_if(s.y_score > t.threshold) AS n_gt
FROM scored_folds s JOIN t ON t.category = s.category GROUP BY s.category, t.threshold""")
def thr_percentile(spark, sf):
    s = fx.scored_folds(spark, sf)
    t = T.percentile_threshold(s, G1, "y_score", 90)
    j = T.apply_threshold(s, t, G1)
    out = j.groupBy("category", "threshold").agg(F.sum("y_pred").alias("n_ge"),
                                                 F.count_if(F.col("y_score") > F.col("threshold")).alias("n_gt"))
    return rounded(out)


_POOLED_SQL = S.with_(S.POSTS, S.COMMENTS) + ", pooled AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS category, {c}_score AS s FROM posts UNION ALL SELECT '{c}', {c}_score FROM comments" for c in CATEGORIES
) + ")\nSELECT category, round(quantile_cont(s, 0.8), 6) AS threshold FROM pooled GROUP BY category"


@register("thr_percentile_pooled", "thresholds", sql=_POOLED_SQL)
def thr_percentile_pooled(spark, sf):
    def long(df):
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"{c}_score").alias("s"))
                                             for c in CATEGORIES])).alias("r")).select("r.category", "r.s")
    pooled = long(fx.posts(spark, sf)).unionByName(long(fx.comments(spark, sf)))
    return rounded(T.percentile_threshold(pooled, G1, "s", 80))


_F1_SQL = W + ", " + S.pr_ctes("scored_folds", G1) + """, f AS (
  SELECT category, threshold, coalesce(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END, 0.0) AS f1
  FROM pr WHERE k > 0
)
SELECT category, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY f1 DESC, threshold ASC) AS r FROM f) WHERE r = 1"""


@register("thr_max_f1", "thresholds", sql=_F1_SQL)
def thr_max_f1(spark, sf):
    return rounded(T.max_f1_threshold(fx.scored_folds(spark, sf), G1))


_GMEAN_SQL = W + ", " + S.roc_ctes("scored_folds", G1) + """
SELECT category, round(threshold, 6) AS threshold, round(gmean, 6) AS gmean FROM (
  SELECT *, sqrt(tpr * (1 - fpr)) AS gmean, row_number() OVER (PARTITION BY category ORDER BY sqrt(tpr * (1 - fpr)) DESC, threshold DESC) AS r FROM roc
) WHERE r = 1"""


@register("thr_gmean", "thresholds", sql=_GMEAN_SQL)
def thr_gmean(spark, sf):
    return rounded(T.max_gmean_threshold(fx.scored_folds(spark, sf), G1))


_YOUDEN_SQL = W + ", " + S.roc_ctes("scored_folds", G1) + """
SELECT category, round(threshold, 6) AS threshold, round(youden, 6) AS youden FROM (
  SELECT *, tpr - fpr AS youden, row_number() OVER (PARTITION BY category ORDER BY tpr - fpr DESC, threshold DESC) AS r FROM roc
) WHERE r = 1"""


@register("thr_youden", "thresholds", sql=_YOUDEN_SQL)
def thr_youden(spark, sf):
    return rounded(T.youden_threshold(fx.scored_folds(spark, sf), G1))


_PRIOR_SQL = W + """, ratio AS (
  SELECT category, avg(y_true) AS pos_share, (1 - avg(y_true)) / avg(y_true) AS r FROM scored_folds WHERE fold > 0 GROUP BY category
), cal AS (
  SELECT s.id, s.category, s.y_score, s.y_score / (s.y_score + r.r * (1 - s.y_score)) AS calibrated, r.r, r.pos_share
  FROM scored_folds s JOIN ratio r ON r.category = s.category WHERE s.fold = 0
)
SELECT id, category, round(y_score, 6) AS y_score, round(calibrated, 6) AS calibrated,
  round(calibrated * r / (1 - calibrated + calibrated * r), 6) AS restored,
  round(0.5 / (0.5 + r * 0.5), 6) AS prior, round(0.5 * r / (1 - 0.5 + 0.5 * r), 6) AS prior_inverse
FROM cal"""


@register("cal_prior", "thresholds", sql=_PRIOR_SQL)
def cal_prior(spark, sf):
    s = fx.scored_folds(spark, sf)
    ratio = K.prior_thresholds(K.prior_ratio(s.where(F.col("fold") > 0), G1))
    test = s.where(F.col("fold") == 0).join(ratio, G1)
    cal = K.prior_calibrate("y_score", "neg_to_pos")
    out = test.select("id", "category", "y_score", cal.alias("calibrated"), "neg_to_pos", "prior", "prior_inverse")
    out = out.withColumn("restored", K.prior_inverse("calibrated", "neg_to_pos"))
    return rounded(out.select("id", "category", "y_score", "calibrated", "restored", "prior", "prior_inverse"))


_EXT_SQL = W + ", train AS (SELECT * FROM scored_folds WHERE fold > 0), test AS (SELECT * FROM scored_folds WHERE fold = 0), " \
    + S.pr_ctes("train", G1) + ", " + S.ranked_ctes("test", ["category", "corpus"], "trc") + """, f AS (
  SELECT category, threshold, coalesce(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END, 0.0) AS f1
  FROM pr WHERE k > 0
), thr AS (
  SELECT category, threshold FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY f1 DESC, threshold ASC) AS r FROM f) WHERE r = 1
), c AS (
  SELECT t.category, t.corpus, h.threshold, count_if(y_true = 1 AND y_score >= h.threshold) AS tp,
         count_if(y_true = 0 AND y_score >= h.threshold) AS fp, count_if(y_true = 1 AND y_score < h.threshold) AS fn
  FROM test t JOIN thr h ON h.category = t.category GROUP BY ALL
), a AS (
  SELECT category, corpus, sum(neg * (tps - pos / 2.0)) / (max(n_pos) * max(n_neg)) AS auc FROM trc WHERE n_pos > 0 AND n_neg > 0 GROUP BY ALL
)
SELECT c.category, c.corpus, round(threshold, 6) AS threshold,
  round(coalesce(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 0), 6) AS f1, round(a.auc, 6) AS auc
FROM c LEFT JOIN a ON a.category = c.category AND a.corpus = c.corpus"""


@register("eval_external", "thresholds", sql=_EXT_SQL)
def eval_external(spark, sf):
    s = fx.scored_folds(spark, sf)
    train, test = s.where(F.col("fold") > 0), s.where(F.col("fold") == 0)
    thr = T.max_f1_threshold(train, G1).select("category", "threshold")
    pred = T.apply_threshold(test, thr, G1)
    m = C.binary_metrics(C.confusion(pred, ["category", "corpus", "threshold"]))
    auc = C.auc_roc(test, ["category", "corpus"])
    return rounded(m.select("category", "corpus", "threshold", "f1").join(auc, ["category", "corpus"], "left"))


@register("cal_platt", "thresholds")
def cal_platt(spark, sf):
    s = fx.scored_folds(spark, sf)
    params = K.platt_fit(s.where(F.col("fold") > 0), G1)
    out = K.platt_apply(s.where(F.col("fold") == 0), params, G1)
    out = out.withColumn("restored", K.platt_inverse("calibrated"))
    return rounded(out.select("id", "category", "y_score", "a", "b", "calibrated", "restored"))


# the min-max formula: the fitted value at a score is the largest, over starts up to it, of the smallest mean to an end from it on
@register("cal_isotonic", "thresholds", sql=W + """, train AS (
  SELECT * FROM scored_folds WHERE fold > 0
), v AS (
  SELECT category, y_score, count(*) AS w, sum(y_true) AS s FROM train GROUP BY ALL
), c AS (
  SELECT *, row_number() OVER o AS k, sum(w) OVER o AS cw, sum(s) OVER o AS cs FROM v WINDOW o AS (PARTITION BY category ORDER BY y_score)
), m AS (
  SELECT a.category, a.k AS a, b.k AS b, (b.cs - a.cs + a.s) / CAST(b.cw - a.cw + a.w AS DOUBLE) AS mean FROM c a JOIN c b ON a.category = b.category AND a.k <= b.k
), least AS (
  SELECT i.category, i.k, m.a, min(m.mean) AS mean FROM c i JOIN m ON m.category = i.category AND m.a <= i.k AND m.b >= i.k GROUP BY ALL
), fit AS (
  SELECT category, k, max(mean) AS value FROM least GROUP BY ALL
)
SELECT t.id, t.category, t.y_true, t.y_score, round(f.value, 6) AS calibrated
FROM train t JOIN c ON c.category = t.category AND c.y_score = t.y_score JOIN fit f ON f.category = c.category AND f.k = c.k""")
def cal_isotonic(spark, sf):
    s = fx.scored_folds(spark, sf).where(F.col("fold") > 0)
    return rounded(K.isotonic_fit_apply(s, G1).select("id", "category", "y_true", "y_score", "calibrated"))
