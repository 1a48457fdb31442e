"""Splits group: stratified train/test flags and stratified folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoscope.operators import split as SP
from annoscope.plans import fixtures as fx, sqlfrag as S
from annoscope.plans.registry import register

SEED = 100
_BASE = S.with_(S.TRISTATE) + f""", lab AS (
  SELECT *, row_number() OVER (PARTITION BY category, label ORDER BY md5(CAST(id AS VARCHAR) || category || '{SEED}')) AS r,
         row_number() OVER (PARTITION BY category, label ORDER BY md5(CAST(id AS VARCHAR) || category || '{SEED}' || 'kfold')) AS r2,
         count(*) OVER (PARTITION BY category, label) AS n
  FROM tristate WHERE label IN (0, 1)
), sp AS (
  SELECT id, category, label, CASE WHEN r <= round(0.1 * n) THEN 0 ELSE 1 END AS train, r2 FROM lab
  UNION ALL SELECT id, category, label, -1, NULL FROM tristate WHERE label NOT IN (0, 1) OR label IS NULL
)
"""


@register("split_train_test", "splits", sql=_BASE + "SELECT id, category, label, train FROM sp")
def split_train_test(spark, sf):
    return SP.stratified_split(fx.tristate_labels(spark, sf), seed=SEED)


@register("split_kfold", "splits", sql=_BASE + """SELECT id, category, label, train,
  CAST(CASE WHEN r2 IS NULL THEN -1 WHEN train = 0 THEN 0 ELSE ((r2 - 1) % 10) + 1 END AS INTEGER) AS fold FROM sp""")
def split_kfold(spark, sf):
    s = SP.stratified_split(fx.tristate_labels(spark, sf), seed=SEED)
    return SP.stratified_kfold(s, k=10, seed=SEED)


@register("split_none", "splits", sql=S.with_(S.TRISTATE) + f""", n AS (
  SELECT id, 'none' AS category, CAST(max(label) <= 0 AS INTEGER) AS label FROM tristate GROUP BY id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || category || '{SEED}')) AS r, count(*) OVER (PARTITION BY label) AS n FROM n
)
SELECT id, category, label, CAST(CASE WHEN r <= round(0.1 * n) THEN 0 ELSE 1 END AS INTEGER) AS train FROM r""")
def split_none(spark, sf):
    """K2: the `none` category (no category present) is split over all rows."""
    t = fx.tristate_labels(spark, sf)
    none = t.groupBy("id").agg((F.max("label") <= 0).cast("int").alias("label")).select("id", F.lit("none").alias("category"), "label")
    return SP.stratified_split(none, seed=SEED)
