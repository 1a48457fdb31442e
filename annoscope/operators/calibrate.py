"""Calibration.

Prior shift is an expression after one small aggregation (one row per group). Platt scaling is fitted with Spark ML per
group: a driver loop over the (few) groups, each fit itself distributed over the rows of its group. Isotonic regression
pools violators in range slices of all groups at once (``isotonic.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from annoscope.operators.curves import score_counts
from annoscope.session import per_group, written


def prior_ratio(train: DataFrame, group_cols: Sequence[str], y: str = "y_true") -> DataFrame:
    """``(group..., pos_share, neg_to_pos)`` from the training labels."""
    g = list(group_cols)
    a = train.groupBy(*g).agg(F.avg(F.col(y).cast("double")).alias("pos_share"))
    return a.withColumn("neg_to_pos", (1 - F.col("pos_share")) / F.col("pos_share"))


def prior_calibrate(p, r) -> Column:
    """M5: ``p / (p + r(1 − p))``."""
    p = F.col(p) if isinstance(p, str) else p
    r = F.col(r) if isinstance(r, str) else r
    return p / (p + r * (1 - p))


def prior_inverse(c, r) -> Column:
    """M6: ``c·r / (1 − c + c·r)``."""
    c = F.col(c) if isinstance(c, str) else c
    r = F.col(r) if isinstance(r, str) else r
    return c * r / (1 - c + c * r)


def prior_thresholds(ratio: DataFrame) -> DataFrame:
    """M7: ``prior`` = calibrate(0.5) = positive share (applied to raw scores); ``prior_inverse``
    = 1 − share, the raw score whose calibrated value is 0.5."""
    return ratio.withColumn("prior", prior_calibrate(F.lit(0.5), F.col("neg_to_pos"))) \
        .withColumn("prior_inverse", prior_inverse(F.lit(0.5), F.col("neg_to_pos")))


def _groups(df: DataFrame, g: list[str]) -> list[tuple]:
    # group keys only (a handful of categories / corpora), never rows
    return [tuple(r) for r in df.select(*g).distinct().collect()] if g else [()]


def _where_group(df: DataFrame, g: list[str], key: tuple) -> DataFrame:
    cond = F.lit(True)
    for c, v in zip(g, key):
        cond = cond & (F.col(c) == F.lit(v))
    return df.where(cond)


def platt_fit(df: DataFrame, group_cols: Sequence[str], y: str = "y_true", s: str = "y_score",
              max_iter: int = 1000, tol: float = 1e-12) -> DataFrame:
    """M8: Platt scaling with Platt's smoothed targets t+ = (N+ + 1)/(N+ + 2), t− = 1/(N− + 2).

    Each row enters twice, (label 1, weight t) and (label 0, weight 1 − t); an unregularised
    weighted logistic regression on the score then gives ``a = −coef``, ``b = −intercept`` with
    calibrated = 1 / (1 + exp(a·s + b)). Returns ``(group..., a, b)``.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    g = list(group_cols)
    scores = written(score_counts(df, g, y, s), "scores")  # rows are read once, then one row per distinct score
    counts = per_group(scores.groupBy(*g).agg(F.sum("pos").alias("_np"), F.sum("neg").alias("_nn")))
    j = scores.join(counts, on=g) if g else scores.crossJoin(counts)
    one = F.col("pos") * (F.col("_np") + 1) / (F.col("_np") + 2) + F.col("neg") / (F.col("_nn") + 2)
    twice = j.select(*g, F.col("score").alias("_s"), F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), one.alias("w")),
        F.struct(F.lit(0.0).alias("label"), (F.col("pos") + F.col("neg") - one).alias("w")))).alias("r"))
    twice = twice.select(*g, "_s", "r.label", "r.w")
    feat = VectorAssembler(inputCols=["_s"], outputCol="features").transform(twice)
    rows = []
    for key in _groups(counts, g):
        part = _where_group(feat, g, key)
        lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", regParam=0.0,
                                standardization=False, maxIter=max_iter, tol=tol)
        m = lr.fit(part)
        rows.append((*key, -float(m.coefficients[0]), -float(m.intercept)))
    schema = ", ".join([f"{c} {dict(df.dtypes)[c]}" for c in g] + ["a double", "b double"])
    return df.sparkSession.createDataFrame(rows, schema)


def platt_apply(df: DataFrame, params: DataFrame, group_cols: Sequence[str], s: str = "y_score",
                out: str = "calibrated") -> DataFrame:
    g = list(group_cols)
    params = per_group(params)
    j = df.join(params, on=g) if g else df.crossJoin(params)
    return j.withColumn(out, 1 / (1 + F.exp(F.col("a") * F.col(s) + F.col("b"))))


def platt_inverse(c, a="a", b="b") -> Column:
    """M9: ``(ln(1 − c) − ln c − b) / a``."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.log(1 - c) - F.log(c) - F.col(b)) / F.col(a)


def isotonic_fit_apply(df: DataFrame, group_cols: Sequence[str], y: str = "y_true", s: str = "y_score",
                       out: str = "calibrated") -> DataFrame:
    """Increasing isotonic regression of the label on the score, per group, applied to the same rows. Rows are
    collapsed to one weighted row per distinct score first; rows without a score or label get no value."""
    from annoscope.operators.isotonic import fitted_values

    g = list(group_cols)
    scores = score_counts(df, g, y, s).select(*g, F.col("score").alias("_s"), F.col("pos").cast("double").alias("_sum"),
                                              (F.col("pos") + F.col("neg")).cast("double").alias("_w"))
    done = fitted_values(scores, g, "_s", "_sum", "_w", out)
    keep = [F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}")) for c in g]
    rows = df.withColumn("_s", F.col(s).cast("double")).alias("d")
    return rows.join(done.alias("f"), [F.col("d._s") == F.col("f._s"), *keep], "left").select(*[F.col(f"d.{c}") for c in df.columns], F.col(f"f.{out}"))
