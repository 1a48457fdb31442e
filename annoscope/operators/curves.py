"""Scorer evaluation: curves, AUC, confusion metrics, calibration bins.

Everything is grouped (any of category, corpus, method, fold). Scores are first collapsed to one
row per ``(group, score)`` with positive/negative counts (partial aggregation before the shuffle),
then ordered work uses the distributed prefix sums of ``prefix.py`` and equi-joins on the vertex
index for neighbours, so a hot group with millions of distinct scores still spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from annoscope.session import per_group, written
from annoscope.operators.prefix import exact_percentiles, running_totals, with_next, with_prev

INF = float("inf")


def score_counts(df: DataFrame, group_cols: Sequence[str], y: str = "y_true", s: str = "y_score") -> DataFrame:
    """``(group..., score, pos, neg)``: one row per distinct score; NULL scores/labels dropped."""
    g = list(group_cols)
    base = df.where(F.col(y).isNotNull() & F.col(s).isNotNull())
    return base.groupBy(*g, F.col(s).cast("double").alias("score")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum((1 - F.col(y)).cast("long")).alias("neg"))


def _totals(counts: DataFrame, g: list[str]) -> DataFrame:
    return counts.groupBy(*g).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                                  F.count(F.lit(1)).alias("n_scores"))


def _join_totals(df: DataFrame, totals: DataFrame, g: list[str]) -> DataFrame:
    return df.join(totals, on=g, how="inner") if g else df.crossJoin(totals)


def ranked_counts(df: DataFrame, group_cols: Sequence[str], y: str = "y_true", s: str = "y_score",
                  descending: bool = True) -> DataFrame:
    """Distinct-score rows with running counts: ``k`` (1-based vertex index), ``tps``, ``fps``
    (cumulative positives/negatives at score >= this one when descending), and group totals."""
    g = list(group_cols)
    counts = score_counts(df, g, y, s).withColumn("_one", F.lit(1).cast("long"))
    cum = running_totals(counts, g, "score", ["pos", "neg", "_one"], descending=descending)
    cum = cum.select(*g, "score", "pos", "neg", F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps"),
                     F.col("cum__one").alias("k"))
    # one row per distinct score: small next to the input, and every curve reads it several times
    return written(_join_totals(cum, per_group(_totals(counts, g)), g), "ranked")


def roc_vertices(df: DataFrame, group_cols: Sequence[str], y: str = "y_true", s: str = "y_score",
                 drop_intermediate: bool = True) -> DataFrame:
    """ROC vertices ``(group..., k, threshold, fps, tps, fpr, tpr)`` in descending-threshold order,
    with the origin ``k = 0, threshold = +inf`` first. ``drop_intermediate`` removes vertices
    whose neighbours are collinear with them (both second differences zero), as the common
    ROC routine does when there are more than two distinct scores. Groups without positives or
    without negatives have no defined rate and are left out."""
    g = list(group_cols)
    rc = ranked_counts(df, g, y, s).where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    if drop_intermediate:
        nx = with_next(rc, g, "k", ["pos", "neg"])
        keep = ((F.col("n_scores") <= 2) | (F.col("k") == 1) | (F.col("k") == F.col("n_scores"))
                | (F.col("pos_next") != F.col("pos")) | (F.col("neg_next") != F.col("neg")))
        rc = nx.where(keep)
    verts = rc.select(*g, "k", F.col("score").alias("threshold"), "fps", "tps", "n_pos", "n_neg")
    origin = rc.where(F.col("k") == 1).select(*g, F.lit(0).cast("long").alias("k"), F.lit(INF).alias("threshold"),
                                             F.lit(0).cast("long").alias("fps"), F.lit(0).cast("long").alias("tps"), "n_pos", "n_neg")
    allv = verts.unionByName(origin)
    return allv.select(*g, "k", "threshold", "fps", "tps", (F.col("fps") / F.col("n_neg")).alias("fpr"),
                       (F.col("tps") / F.col("n_pos")).alias("tpr"))


def pr_vertices(df: DataFrame, group_cols: Sequence[str], y: str = "y_true", s: str = "y_score") -> DataFrame:
    """Precision-recall vertices ``(group..., k, threshold, recall, precision)`` in ascending-recall
    order: ``k = 0`` is (recall 0, precision 1, threshold NULL), then distinct scores from the
    highest down to the first one that reaches full recall. Groups without positives left out."""
    g = list(group_cols)
    rc = ranked_counts(df, g, y, s).where(F.col("n_pos") > 0)
    # keep vertices up to the first one with tps == P
    first_full = rc.where(F.col("tps") == F.col("n_pos")).groupBy(*g).agg(F.min("k").alias("_kfull"))
    rc = rc.join(first_full, on=g, how="inner") if g else rc.crossJoin(first_full)
    rc = rc.where(F.col("k") <= F.col("_kfull"))
    verts = rc.select(*g, "k", F.col("score").alias("threshold"), (F.col("tps") / F.col("n_pos")).alias("recall"),
                      (F.col("tps") / (F.col("tps") + F.col("fps"))).alias("precision"))
    origin = rc.where(F.col("k") == 1).select(*g, F.lit(0).cast("long").alias("k"), F.lit(None).cast("double").alias("threshold"),
                                             F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return verts.unionByName(origin)


def trapezoid_area(vertices: DataFrame, group_cols: Sequence[str], x: str, y: str, name: str = "auc") -> DataFrame:
    """Σ (x_k − x_{k−1})(y_k + y_{k−1}) / 2 over consecutive vertices (``k`` order)."""
    g = list(group_cols)
    p = with_prev(vertices.select(*g, "k", x, y), g, "k", [x, y])
    seg = (F.col(x) - F.col(f"{x}_prev")) * (F.col(y) + F.col(f"{y}_prev")) / 2
    return p.where(F.col(f"{x}_prev").isNotNull()).groupBy(*g).agg(F.sum(seg).alias(name))


def auc_roc(df: DataFrame, group_cols: Sequence[str], y: str = "y_true", s: str = "y_score", name: str = "auc") -> DataFrame:
    """Trapezoid ROC AUC without vertices: Σ_s neg_s · (tps_s − pos_s/2) / (P·N), scores descending.
    Equal to the rank-sum (Mann–Whitney) AUC with average ranks for ties."""
    g = list(group_cols)
    # one consumer: the running counts are summed as they come, and the group's totals in the same aggregation
    cum = running_totals(score_counts(df, g, y, s), g, "score", ["pos", "neg"], descending=True)
    term = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    sums = cum.groupBy(*g).agg(F.sum(term).alias("_a"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")).where((F.col("_p") > 0) & (F.col("_n") > 0))
    return sums.select(*g, (F.col("_a") / (F.col("_p") * F.col("_n"))).alias(name))


def auc_pr(df: DataFrame, group_cols: Sequence[str], y: str = "y_true", s: str = "y_score", name: str = "auc_pr") -> DataFrame:
    return trapezoid_area(pr_vertices(df, group_cols, y, s), group_cols, "recall", "precision", name)


def average_precision(df: DataFrame, group_cols: Sequence[str], y: str = "y_true", s: str = "y_score",
                      name: str = "avg_prec") -> DataFrame:
    """Σ_k (R_k − R_{k−1}) · P_k over distinct thresholds (descending)."""
    g = list(group_cols)
    rc = ranked_counts(df, g, y, s).where(F.col("n_pos") > 0)
    term = (F.col("pos") / F.col("n_pos")) * (F.col("tps") / (F.col("tps") + F.col("fps")))
    return rc.groupBy(*g).agg(F.sum(term).alias(name))


def interpolate_grid(vertices: DataFrame, group_cols: Sequence[str], x: str, y: str, n: int = 100,
                     force: tuple[int, float] | None = None, left_fill: bool = True) -> DataFrame:
    """Linear interpolation of ``y`` at ``n`` evenly spaced ``x`` in [0, 1] (grid_i = i·(1/(n−1))).

    Semantics of NumPy's ``interp``: for a grid point the segment starts at the *last* vertex (in
    ``k`` order) whose x is <= the point; beyond the last vertex its y is used. Each segment
    explodes only the grid points it covers (≈ n + vertices rows per group). ``force=(i, v)`` sets
    grid point ``i`` to ``v`` afterwards. ``left_fill=False`` skips the fill left of the first
    vertex (ROC and PR curves start at x = 0, so there is nothing to fill).
    Returns ``(group..., i, grid, value)``.
    """
    g = list(group_cols)
    step = 1.0 / (n - 1)
    v = vertices.select(*g, "k", F.col(x).alias("_x"), F.col(y).alias("_y"))
    nx = with_next(v, g, "k", ["_x", "_y"])
    lo_i = F.greatest(F.floor(F.col("_x") * (n - 1)) - 1, F.lit(0)).cast("int")
    hi_i = F.when(F.col("_x_next").isNull(), F.lit(n - 1)).otherwise(
        F.least(F.ceil(F.col("_x_next") * (n - 1)) + 1, F.lit(n - 1))).cast("int")
    seg = nx.where(F.col("_x_next").isNull() | (F.col("_x_next") > F.col("_x")))
    ex = seg.select("*", F.explode(F.sequence(lo_i, hi_i)).alias("i"))
    grid = F.col("i") * F.lit(step)
    inside = (grid >= F.col("_x")) & (F.col("_x_next").isNull() | (grid < F.col("_x_next")))
    val = F.when(F.col("_x_next").isNull(), F.col("_y")).otherwise(
        F.col("_y") + (grid - F.col("_x")) * (F.col("_y_next") - F.col("_y")) / (F.col("_x_next") - F.col("_x")))
    out = ex.where(inside).select(*g, "i", grid.alias("grid"), val.alias("value"))
    if left_fill:
        # grid points left of the first vertex take the first vertex's y (np.interp's left value)
        first = v.groupBy(*g).agg(F.min_by("_x", "k").alias("_x0"), F.min_by("_y", "k").alias("_y0"))
        left = first.select(*g, "_x0", "_y0", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")) \
            .where(F.col("i") * F.lit(step) < F.col("_x0")).select(*g, "i", (F.col("i") * F.lit(step)).alias("grid"),
                                                                    F.col("_y0").alias("value"))
        out = out.unionByName(left)
    if force is not None:
        fi, fv = force
        out = out.withColumn("value", F.when(F.col("i") == fi, F.lit(float(fv))).otherwise(F.col("value")))
    return out


def roc_interpolated(df: DataFrame, group_cols: Sequence[str], y: str = "y_true", s: str = "y_score", n: int = 100) -> DataFrame:
    """L4: TPR at ``n`` FPR grid points, the last forced to 1. Interpolates over all vertices
    (dropping collinear ones cannot change a linear interpolation), so ``k`` stays consecutive."""
    v = roc_vertices(df, group_cols, y, s, drop_intermediate=False)
    return interpolate_grid(v, group_cols, "fpr", "tpr", n, force=(n - 1, 1.0), left_fill=False) \
        .withColumnRenamed("grid", "fpr").withColumnRenamed("value", "tpr")


def pr_interpolated(df: DataFrame, group_cols: Sequence[str], y: str = "y_true", s: str = "y_score", n: int = 100) -> DataFrame:
    """Precision at ``n`` recall grid points, the first forced to 1."""
    v = pr_vertices(df, group_cols, y, s)
    return interpolate_grid(v, group_cols, "recall", "precision", n, force=(0, 1.0), left_fill=False) \
        .withColumnRenamed("grid", "recall").withColumnRenamed("value", "precision")


# ---------------------------------------------------------------- confusion-based metrics

def median_predictions(df: DataFrame, group_cols: Sequence[str], s: str = "y_score", out: str = "y_pred") -> DataFrame:
    """L1: ``y_pred = score >= median(score)`` of the group (exact median, distributed)."""
    g = list(group_cols)
    med = per_group(exact_percentiles(df, g, s, probs=[0.5]).select(*g, F.col("value").alias("_median")))
    j = df.join(med, on=g, how="inner") if g else df.crossJoin(med)
    return j.withColumn(out, (F.col(s) >= F.col("_median")).cast("int")).drop("_median")


def confusion(df: DataFrame, group_cols: Sequence[str], y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    g = list(group_cols)
    yc, pc = F.col(y), F.col(pred)
    return df.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((yc == 1) & (pc == 1)).alias("tp"), F.count_if((yc == 0) & (pc == 1)).alias("fp"),
        F.count_if((yc == 0) & (pc == 0)).alias("tn"), F.count_if((yc == 1) & (pc == 0)).alias("fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_metrics(conf: DataFrame) -> DataFrame:
    """L2: accuracy, precision, recall, F1 from confusion counts (0 when undefined)."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    prec, rec = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return conf.select("*", _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), prec.alias("precision"),
                       rec.alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def mean_sd_ci(df: DataFrame, group_cols: Sequence[str], value: str, confidence: float = 0.95) -> DataFrame:
    """Mean, mean ± population sd, and the t confidence interval with the sample standard error."""
    from annoscope.functions.dist import t_quantile

    g = list(group_cols)
    a = df.groupBy(*g).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("_sd"),
                           F.stddev_samp(value).alias("_ss"), F.count(value).alias("_n"))
    tq = t_quantile(F.lit((1 + confidence) / 2), (F.col("_n") - 1).cast("double"))
    half = tq * F.col("_ss") / F.sqrt(F.col("_n"))
    return a.select(*g, "mean", (F.col("mean") - F.col("_sd")).alias("sd_lower"), (F.col("mean") + F.col("_sd")).alias("sd_upper"),
                    (F.col("mean") - half).alias("ci_lower"), (F.col("mean") + half).alias("ci_upper"))


def brier(df: DataFrame, group_cols: Sequence[str], y: str = "y_true", p: str = "y_score") -> DataFrame:
    """Mean squared difference of probability and label."""
    return df.groupBy(*group_cols).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def calibration_bin(p, n_bins: int) -> Column:
    """Bin of a probability with NumPy-linspace edges; bins are (lo, hi], the first includes 0."""
    step = 1.0 / n_bins
    pc = F.col(p) if isinstance(p, str) else p
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(n_bins - 1)), lambda j: j * F.lit(step) < pc))


def reliability(df: DataFrame, group_cols: Sequence[str], y: str = "y_true", p: str = "y_score", n_bins: int = 10) -> DataFrame:
    """Per non-empty bin ``n``, fraction positive, mean predicted; plus ``mse`` = the
    unweighted mean over the group's non-empty bins of (fraction − mean predicted)²."""
    g = list(group_cols)
    bins = df.groupBy(*g, calibration_bin(p, n_bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("frac_pos"), F.avg(p).alias("mean_pred"))
    mse = bins.groupBy(*g).agg(F.avg(F.pow(F.col("frac_pos") - F.col("mean_pred"), 2)).alias("mse"))
    return bins.join(mse, on=g, how="inner") if g else bins.crossJoin(mse)


def metric_matrix(metrics: DataFrame, row: str, column: str, value: str, digits: int = 2) -> DataFrame:
    """A table of one row per ``row`` and one rounded column per distinct ``column`` (its values, such as corpora or
    methods, become column names and are read to the driver; NULL where a pair has no value)."""
    names = [r[0] for r in metrics.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    return metrics.groupBy(row).pivot(column, names).agg(F.round(F.first(value), digits))
