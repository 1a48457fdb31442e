"""Evaluation group: slices, fold predictions, confusion metrics, ROC/PR curves and their
interpolations, k-fold aggregates, AUC grids, F1 levels, Brier, reliability, report, top-k."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from annoscope.operators import curves as C
from annoscope.operators.prefix import exact_percentiles
from annoscope.plans import fixtures as fx, sqlfrag as S
from annoscope.plans.catalog._util import rounded
from annoscope.plans.registry import register
from annoscope.session import per_group, scratch_path
from annoscope.sources import readers, sinks

G2 = ["category", "corpus"]
# The percentile levels of the threshold table.
F1_LEVELS = (95, 90, 80, 70, 60, 50)
T_975_DF9 = 2.262157162798239  # Student t 0.975 quantile, 9 degrees of freedom (10 folds)
W = S.with_(S.SCORED_FOLDS)


def _r(cols):
    return ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" for c in cols)


# ---------------------------------------------------------------- slices and fold files

@register("eval_slice", "evaluation", sql=W + "SELECT id, category, y_true, y_score FROM scored_folds WHERE corpus = 'en' AND fold > 0")
def eval_slice(spark, sf):
    s = fx.scored_folds(spark, sf)
    return s.where((F.col("corpus") == "en") & (F.col("fold") > 0)).select("id", "category", "y_true", "y_score")


@register("eval_load_folds", "evaluation", sql=W + """SELECT category, fold, y_true, y_score, CAST(y_score >= 0.5 AS INTEGER) AS y_pred
FROM scored_folds WHERE fold > 0""")
def eval_load_folds(spark, sf):
    """Per-category cross-validation predictions written as fold-record JSON files (one folder
    per category, as the reference writes one file per foundation) and read back."""
    from annoscope.schema import CATEGORIES

    s = fx.scored_folds(spark, sf).where(F.col("fold") > 0).withColumn("y_pred", (F.col("y_score") >= 0.5).cast("int"))
    base = scratch_path(spark, "fold_predictions")
    for c in CATEGORIES:
        sinks.write_fold_predictions(s.where(F.col("category") == c).select("fold", "y_true", "y_score", "y_pred"), f"{base}/{c}")
    parts = [readers.read_fold_predictions(spark, f"{base}/{c}").select(F.lit(c).alias("category"), "fold", "y_true", "y_score", "y_pred")
             for c in CATEGORIES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- confusion metrics

@register("eval_fold", "evaluation", sql=W + """, m AS (
  SELECT category, fold, median(y_score) AS med FROM scored_folds WHERE fold > 0 GROUP BY category, fold
), p AS (
  SELECT s.category, s.fold, s.y_true, CAST(s.y_score >= m.med AS INTEGER) AS y_pred
  FROM scored_folds s JOIN m ON m.category = s.category AND m.fold = s.fold WHERE s.fold > 0
), c AS (
  SELECT category, fold, count(*) AS n, count_if(y_true = 1 AND y_pred = 1) AS tp, count_if(y_true = 0 AND y_pred = 1) AS fp,
         count_if(y_true = 0 AND y_pred = 0) AS tn, count_if(y_true = 1 AND y_pred = 0) AS fn
  FROM p GROUP BY category, fold
)
SELECT category, fold, n, tp, fp, tn, fn,
  round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
  round(coalesce(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 0), 6) AS precision,
  round(coalesce(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 0), 6) AS recall,
  round(coalesce(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 0), 6) AS f1
FROM c""")
def eval_fold(spark, sf):
    s = fx.scored_folds(spark, sf).where(F.col("fold") > 0)
    p = C.median_predictions(s, ["category", "fold"])
    return rounded(C.binary_metrics(C.confusion(p, ["category", "fold"])))


# ---------------------------------------------------------------- curves

@register("eval_roc", "evaluation", sql=W + ", " + S.roc_ctes("scored_folds", G2)
          + "\nSELECT category, corpus, k, threshold, fps, tps, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc")
def eval_roc(spark, sf):
    return rounded(C.roc_vertices(fx.scored_folds(spark, sf), G2))


@register("eval_pr", "evaluation", sql=W + ", " + S.pr_ctes("scored_folds", G2)
          + "\nSELECT category, corpus, k, threshold, round(recall, 6) AS recall, round(precision, 6) AS precision FROM pr")
def eval_pr(spark, sf):
    return rounded(C.pr_vertices(fx.scored_folds(spark, sf), G2))


@register("eval_roc_interp", "evaluation", sql=W + ", " + S.roc_ctes("scored_folds", G2) + ", "
          + S.interp_ctes("roc", G2, "fpr", "tpr", "ri", force=(99, 1.0))
          + "\nSELECT category, corpus, i, round(grid, 6) AS fpr, round(value, 6) AS tpr FROM ri")
def eval_roc_interp(spark, sf):
    return rounded(C.roc_interpolated(fx.scored_folds(spark, sf), G2))


@register("eval_pr_interp", "evaluation", sql=W + ", " + S.pr_ctes("scored_folds", G2) + ", "
          + S.interp_ctes("pr", G2, "recall", "precision", "pi", force=(0, 1.0))
          + "\nSELECT category, corpus, i, round(grid, 6) AS recall, round(value, 6) AS precision FROM pi")
def eval_pr_interp(spark, sf):
    return rounded(C.pr_interpolated(fx.scored_folds(spark, sf), G2))


# ---------------------------------------------------------------- k-fold aggregate

_GF = ["category", "fold"]
_KFOLD_SQL = W + ", cv AS (SELECT * FROM scored_folds WHERE fold > 0), " + S.roc_ctes("cv", _GF) + ", " \
    + S.pr_ctes("cv", _GF) + ", " + S.interp_ctes("roc", _GF, "fpr", "tpr", "ri", force=(99, 1.0)) + ", " \
    + S.interp_ctes("pr", _GF, "recall", "precision", "pi", force=(0, 1.0)) + f""",
auc_r AS (SELECT category, fold, sum((fpr - pf) * (tpr + pt) / 2) AS v FROM
  (SELECT *, lag(fpr) OVER (PARTITION BY category, fold ORDER BY k) AS pf, lag(tpr) OVER (PARTITION BY category, fold ORDER BY k) AS pt FROM roc)
  WHERE pf IS NOT NULL GROUP BY category, fold),
auc_p AS (SELECT category, fold, sum((recall - pr_) * (precision + pp) / 2) AS v FROM
  (SELECT *, lag(recall) OVER (PARTITION BY category, fold ORDER BY k) AS pr_, lag(precision) OVER (PARTITION BY category, fold ORDER BY k) AS pp FROM pr)
  WHERE pr_ IS NOT NULL GROUP BY category, fold),
vals AS (
  SELECT category, 'auc_roc' AS metric, -1 AS i, v FROM auc_r
  UNION ALL SELECT category, 'auc_pr', -1, v FROM auc_p
  UNION ALL SELECT category, 'tpr', i, value FROM ri
  UNION ALL SELECT category, 'precision', i, value FROM pi
), agg AS (
  SELECT category, metric, i, avg(v) AS mean, stddev_pop(v) AS sd, stddev_samp(v) AS ss, count(v) AS n FROM vals GROUP BY ALL
)
SELECT category, metric, i, round(mean, 6) AS mean, round(mean - sd, 6) AS sd_lower, round(mean + sd, 6) AS sd_upper,
       round(mean - {T_975_DF9} * ss / sqrt(n), 6) AS ci_lower, round(mean + {T_975_DF9} * ss / sqrt(n), 6) AS ci_upper
FROM agg"""


@register("eval_kfold", "evaluation", sql=_KFOLD_SQL)
def eval_kfold(spark, sf):
    cv = fx.scored_folds(spark, sf).where(F.col("fold") > 0)
    roc_v = C.roc_vertices(cv, _GF, drop_intermediate=False)
    pr_v = C.pr_vertices(cv, _GF)
    auc_r = C.trapezoid_area(roc_v, _GF, "fpr", "tpr", "v").select("category", F.lit("auc_roc").alias("metric"),
                                                                   F.lit(-1).alias("i"), "v")
    auc_p = C.trapezoid_area(pr_v, _GF, "recall", "precision", "v").select("category", F.lit("auc_pr").alias("metric"),
                                                                          F.lit(-1).alias("i"), "v")
    ri = C.interpolate_grid(roc_v, _GF, "fpr", "tpr", force=(99, 1.0), left_fill=False).select(
        "category", F.lit("tpr").alias("metric"), "i", F.col("value").alias("v"))
    pi = C.interpolate_grid(pr_v, _GF, "recall", "precision", force=(0, 1.0), left_fill=False).select(
        "category", F.lit("precision").alias("metric"), "i", F.col("value").alias("v"))
    vals = auc_r.unionByName(auc_p).unionByName(ri).unionByName(pi)
    return rounded(C.mean_sd_ci(vals, ["category", "metric", "i"], "v", 0.95))


# ---------------------------------------------------------------- AUC grid (category x corpus)

@register("eval_auc_grid", "evaluation", sql=W + ", " + S.ranked_ctes("scored_folds", G2) + f""",
auc AS (SELECT category, corpus, sum(neg * (tps - pos / 2.0)) / (max(n_pos) * max(n_neg)) AS auc FROM rc WHERE n_pos > 0 AND n_neg > 0 GROUP BY ALL)
SELECT category, corpus, round(auc, 2) AS auc FROM auc""")
def eval_auc_grid(spark, sf):
    auc = C.auc_roc(fx.scored_folds(spark, sf), G2)
    return rounded(auc.select("category", "corpus", F.round("auc", 2).alias("auc")))


@register("eval_auc_matrix", "evaluation", sql="SELECT * FROM (PIVOT (" + W + ", " + S.ranked_ctes("scored_folds", G2) + """,
auc AS (SELECT category, corpus, sum(neg * (tps - pos / 2.0)) / (max(n_pos) * max(n_neg)) AS auc FROM rc WHERE n_pos > 0 AND n_neg > 0 GROUP BY ALL)
SELECT category, corpus, round(auc, 2) AS auc FROM auc) ON corpus USING first(auc) GROUP BY category)""")
def eval_auc_matrix(spark, sf):
    """Categories x corpora as a wide table."""
    return C.metric_matrix(C.auc_roc(fx.scored_folds(spark, sf), G2), "category", "corpus", "auc")


# ---------------------------------------------------------------- F1 at percentile levels

@register("eval_f1_levels", "evaluation", sql=W + f""", lv AS (SELECT UNNEST([{', '.join(map(str, F1_LEVELS))}]) AS level),
q AS (SELECT category, corpus, quantile_cont(y_score, [{', '.join(repr(lv / 100.0) for lv in F1_LEVELS)}]) AS qs
      FROM scored_folds GROUP BY ALL),
thr AS (SELECT category, corpus, UNNEST([{', '.join(map(str, F1_LEVELS))}]) AS level, UNNEST(qs) AS threshold FROM q),
p AS (SELECT t.category, t.corpus, t.level, t.threshold, s.y_true, CAST(s.y_score >= t.threshold AS INTEGER) AS y_pred
      FROM scored_folds s JOIN thr t ON t.category = s.category AND t.corpus = s.corpus),
c AS (SELECT category, corpus, level, threshold, count_if(y_true = 1 AND y_pred = 1) AS tp,
             count_if(y_true = 0 AND y_pred = 1) AS fp, count_if(y_true = 1 AND y_pred = 0) AS fn FROM p GROUP BY ALL)
SELECT category, corpus, level, round(threshold, 6) AS threshold,
       round(coalesce(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 0), 6) AS f1 FROM c""")
def eval_f1_levels(spark, sf):
    s = fx.scored_folds(spark, sf)
    groups = s.select(*G2).distinct()
    levels = spark.createDataFrame([(lv,) for lv in F1_LEVELS], "level int")
    probs = groups.crossJoin(F.broadcast(levels)).withColumn("prob", F.col("level") / 100.0)
    thr = exact_percentiles(s, G2, "y_score", probs_df=probs, out_col="threshold")
    thr = thr.join(probs, on=[*G2, "prob"]).select(*G2, "level", "threshold")
    # one row per distinct score meets the few levels of its group, not every raw row
    p = C.score_counts(s, G2).join(per_group(thr), on=G2)
    over = lambda c, hit: F.sum(F.when((F.col("score") >= F.col("threshold")) == hit, F.col(c)).otherwise(0))
    m = C.binary_metrics(p.groupBy(*G2, "level", "threshold").agg(
        over("pos", True).alias("tp"), over("neg", True).alias("fp"), over("neg", False).alias("tn"), over("pos", False).alias("fn")))
    return rounded(m.select(*G2, "level", "threshold", "f1"))


# ---------------------------------------------------------------- Brier, reliability

@register("eval_brier", "evaluation", sql=W + "SELECT category, corpus, round(avg(pow(y_score - y_true, 2)), 6) AS brier FROM scored_folds GROUP BY ALL")
def eval_brier(spark, sf):
    return rounded(C.brier(fx.scored_folds(spark, sf), G2))


@register("eval_reliability", "evaluation", sql=W + f""", b AS (
  SELECT category, CAST(len(list_filter(range(1, 10), lambda j: j * {1.0 / 10!r}::DOUBLE < y_score)) AS INTEGER) AS bin, y_true, y_score FROM scored_folds
), bins AS (SELECT category, bin, count(*) AS n, avg(y_true) AS frac_pos, avg(y_score) AS mean_pred FROM b GROUP BY ALL),
mse AS (SELECT category, avg(pow(frac_pos - mean_pred, 2)) AS mse FROM bins GROUP BY category)
SELECT bins.category, bin, n, round(frac_pos, 6) AS frac_pos, round(mean_pred, 6) AS mean_pred, round(mse, 6) AS mse
FROM bins JOIN mse ON mse.category = bins.category""")
def eval_reliability(spark, sf):
    return rounded(C.reliability(fx.scored_folds(spark, sf), ["category"], n_bins=10))


# ---------------------------------------------------------------- report

_REPORT_SQL = W + ", " + S.ranked_ctes("scored_folds", G2) + """,
rank_m AS (
  SELECT category, corpus, sum(neg * (tps - pos / 2.0)) / (max(n_pos) * max(n_neg)) AS auroc,
         sum((pos / n_pos) * (tps / (tps + fps))) AS avg_prec FROM rc WHERE n_pos > 0 AND n_neg > 0 GROUP BY ALL
), c AS (
  SELECT category, corpus, count(*) AS n, avg(y_true) * 100 AS pct_pos,
         count_if(y_true = 1 AND y_score >= 0.5) AS tp, count_if(y_true = 0 AND y_score >= 0.5) AS fp,
         count_if(y_true = 0 AND y_score < 0.5) AS tn, count_if(y_true = 1 AND y_score < 0.5) AS fn
  FROM scored_folds GROUP BY ALL
)
SELECT c.category, c.corpus, n, round(pct_pos, 6) AS pct_pos,
  round((tp + tn) / n, 6) AS accuracy,
  round((coalesce(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 0) + coalesce(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END, 0)) / 2, 6) AS bal_acc,
  round(coalesce(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 0), 6) AS precision,
  round(coalesce(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 0), 6) AS recall,
  round(coalesce(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 0), 6) AS f1,
  round(CASE WHEN tp + fn > 0 AND fp > 0 THEN (tp / (tp + fn)) / (fp / (fp + tn)) END, 6) AS lr_plus,
  round(avg_prec, 6) AS avg_prec, round(auroc, 6) AS auroc
FROM c JOIN rank_m r ON r.category = c.category AND r.corpus = c.corpus"""


@register("eval_report", "evaluation", sql=_REPORT_SQL)
def eval_report(spark, sf):
    s = fx.scored_folds(spark, sf).withColumn("y_pred", (F.col("y_score") >= 0.5).cast("int"))
    conf = C.confusion(s, G2)
    pos = s.groupBy(*G2).agg((F.avg("y_true") * 100).alias("pct_pos"))
    m = C.binary_metrics(conf).join(pos, G2)
    tpr = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    tnr = F.try_divide(F.col("tn").cast("double"), (F.col("tn") + F.col("fp")).cast("double"))
    fpr = F.try_divide(F.col("fp").cast("double"), (F.col("fp") + F.col("tn")).cast("double"))
    m = m.select(*G2, "n", "pct_pos", "accuracy", ((F.coalesce(tpr, F.lit(0.0)) + F.coalesce(tnr, F.lit(0.0))) / 2).alias("bal_acc"),
                 "precision", "recall", "f1", F.when(fpr > 0, tpr / fpr).alias("lr_plus"))
    rank_m = C.auc_roc(s, G2, name="auroc").join(C.average_precision(s, G2), G2)
    return rounded(m.join(rank_m, G2))


# ---------------------------------------------------------------- top-k examples

_CELL = """CASE WHEN y_true = 1 AND y_pred = 1 THEN 'TP' WHEN y_true = 0 AND y_pred = 1 THEN 'FP'
            WHEN y_true = 0 AND y_pred = 0 THEN 'TN' ELSE 'FN' END"""


@register("topk_confusion", "evaluation", sql=W + f""", p AS (
  SELECT category, id, y_score, y_true, CAST(y_score >= 0.5 AS INTEGER) AS y_pred FROM scored_folds
), c AS (SELECT *, {_CELL} AS cell FROM p), r AS (
  SELECT category, cell, id, y_score,
         row_number() OVER (PARTITION BY category, cell ORDER BY CASE WHEN cell IN ('TP', 'FP') THEN -y_score ELSE y_score END, id) AS rank
  FROM c
) SELECT category, cell, CAST(rank AS INTEGER) AS rank, id, y_score FROM r WHERE rank <= 5""")
def topk_confusion(spark, sf, k: int = 5):
    s = fx.scored_folds(spark, sf).withColumn("y_pred", (F.col("y_score") >= 0.5).cast("int"))
    cell = (F.when((F.col("y_true") == 1) & (F.col("y_pred") == 1), "TP").when((F.col("y_true") == 0) & (F.col("y_pred") == 1), "FP")
            .when((F.col("y_true") == 0) & (F.col("y_pred") == 0), "TN").otherwise("FN"))
    c = s.withColumn("cell", cell)
    key = F.when(F.col("cell").isin("TP", "FP"), -F.col("y_score")).otherwise(F.col("y_score"))
    w = Window.partitionBy("category", "cell").orderBy(key, F.col("id"))
    # row_number() <= k is planned as a WindowGroupLimit below the shuffle (map-side top-k)
    r = c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return r.select("category", "cell", "rank", "id", "y_score")


@register("topk_hard_positive", "evaluation", sql=W + """SELECT category, corpus, id, y_score FROM (
  SELECT *, row_number() OVER (PARTITION BY category, corpus ORDER BY y_score, id) AS r FROM scored_folds WHERE y_true = 1
) WHERE r = 1""")
def topk_hard_positive(spark, sf):
    s = fx.scored_folds(spark, sf).where(F.col("y_true") == 1)
    w = Window.partitionBy(*G2).orderBy("y_score", "id")
    return s.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(*G2, "id", "y_score")


# ---------------------------------------------------------------- AUC by method × category × corpus

def _methods_long(spark, sf):
    """Two scorers of the same labelled documents in long form: the binary scorer fixture and the
    word-count lexicon scores (A16: pre-scored inputs united by name with a method column)."""
    from annoscope.plans.catalog.lexicon import lexicon_scores
    from annoscope.schema import CATEGORIES

    a = fx.scored_folds(spark, sf).select(F.lit("scorer").alias("method"), "category", "corpus", "id", "y_true", "y_score")
    lab = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y_true"))
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("corpus"))
    lex = lexicon_scores(spark, sf).join(lab, "id").join(docs, "id")
    b = lex.select(F.lit("lexicon").alias("method"), "corpus", "id", "y_true", F.explode(F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(c).alias("y_score")) for c in CATEGORIES])).alias("r")) \
        .select("method", F.col("r.category").alias("category"), "corpus", "id", "y_true", F.col("r.y_score").alias("y_score"))
    return a.unionByName(b)


def _methods_sql():
    from annoscope.plans.catalog.lexicon import SCORE_LEX_CTES
    from annoscope.schema import CATEGORIES

    lex_long = " UNION ALL ".join(
        f"SELECT 'lexicon' AS method, '{c}' AS category, d.lang AS corpus, x.id, l.quality AS y_true, x.{c} AS y_score "
        f"FROM lexscores x JOIN labels l ON l.doc_id = x.id JOIN documents d ON d.doc_id = x.id" for c in CATEGORIES)
    return ("WITH " + SCORE_LEX_CTES + ",\n" + S.SCORED_FOLDS + f""",
mlong AS (SELECT 'scorer' AS method, category, corpus, id, y_true, y_score FROM scored_folds UNION ALL {lex_long}),
""" + S.ranked_ctes("mlong", ["method", "category", "corpus"]) + f""",
auc AS (SELECT method, category, corpus, sum(neg * (tps - pos / 2.0)) / (max(n_pos) * max(n_neg)) AS auc
        FROM rc WHERE n_pos > 0 AND n_neg > 0 GROUP BY ALL)
SELECT method, category, corpus, round(auc, 2) AS auc FROM auc""")


@register("eval_auc_methods", "evaluation", sql=_methods_sql())
def eval_auc_methods(spark, sf):
    auc = C.auc_roc(_methods_long(spark, sf), ["method", "category", "corpus"])
    return rounded(auc.select("method", "category", "corpus", F.round("auc", 2).alias("auc")))
