"""Threshold rules.

Arg-max rules run over curve vertices with ``max_by(threshold, struct(metric, tie_key))`` — one
grouped aggregation, no sort of the group. Percentile thresholds use the distributed exact
order-statistic selection, or Spark's ``percentile_approx`` when ``exact=False``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from annoscope.operators.curves import pr_vertices, roc_vertices
from annoscope.operators.prefix import exact_percentiles


def percentile_threshold(df: DataFrame, group_cols: Sequence[str], s: str, q: float, exact: bool = True,
                         name: str = "threshold", accuracy: int = 10000) -> DataFrame:
    """The ``q``-th percentile (0..100, linear interpolation) of ``s`` per group."""
    if not 0 <= q <= 100:
        raise ValueError("q must be in [0, 100]")
    g = list(group_cols)
    if exact:
        return exact_percentiles(df, g, s, probs=[q / 100.0]).select(*g, F.col("value").alias(name))
    return df.groupBy(*g).agg(F.percentile_approx(F.col(s), q / 100.0, accuracy).cast("double").alias(name))


def max_f1_threshold(df: DataFrame, group_cols: Sequence[str], y: str = "y_true", s: str = "y_score",
                     name: str = "threshold") -> DataFrame:
    """M1: threshold of the PR vertex with the largest F1; ties -> lowest threshold; 0/0 -> 0."""
    g = list(group_cols)
    v = pr_vertices(df, g, y, s).where(F.col("k") > 0)
    pr, rc = F.col("precision"), F.col("recall")
    f1 = F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0))
    return v.groupBy(*g).agg(F.max_by("threshold", F.struct(f1, -F.col("threshold"))).alias(name),
                             F.max(f1).alias("f1"))


def max_gmean_threshold(df: DataFrame, group_cols: Sequence[str], y: str = "y_true", s: str = "y_score",
                        name: str = "threshold") -> DataFrame:
    """M2: ROC vertex maximising sqrt(TPR·(1−FPR)); ties -> highest threshold."""
    g = list(group_cols)
    v = roc_vertices(df, g, y, s)
    gm = F.sqrt(F.col("tpr") * (1 - F.col("fpr")))
    return v.groupBy(*g).agg(F.max_by("threshold", F.struct(gm, F.col("threshold"))).alias(name),
                             F.max(gm).alias("gmean"))


def youden_threshold(df: DataFrame, group_cols: Sequence[str], y: str = "y_true", s: str = "y_score",
                     name: str = "threshold") -> DataFrame:
    """M3: ROC vertex maximising TPR − FPR; ties -> highest threshold."""
    g = list(group_cols)
    v = roc_vertices(df, g, y, s)
    j = F.col("tpr") - F.col("fpr")
    return v.groupBy(*g).agg(F.max_by("threshold", F.struct(j, F.col("threshold"))).alias(name),
                             F.max(j).alias("youden"))


def apply_threshold(df: DataFrame, thresholds: DataFrame, group_cols: Sequence[str], s: str = "y_score",
                    threshold: str = "threshold", strict: bool = False, out: str = "y_pred") -> DataFrame:
    """Join per-group thresholds (one row per group, written so that Spark broadcasts them by size) and binarise."""
    from annoscope.session import per_group

    g = list(group_cols)
    t = per_group(thresholds.select(*g, threshold))
    j = df.join(t, on=g, how="inner") if g else df.crossJoin(t)
    cmp = F.col(s) > F.col(threshold) if strict else F.col(s) >= F.col(threshold)
    return j.withColumn(out, cmp.cast("int"))
