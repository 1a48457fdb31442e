"""Reproducible stratified splits and folds.

Order inside a stratum is ``md5(id ‖ stratum ‖ seed)``; positions come from the distributed
prefix sums (range partitioning), so a stratum holding a third of all rows is never sorted in one
task. The contract (as sklearn's shuffle cannot be reproduced) is: class proportions, disjoint
parts, determinism for a seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from annoscope.operators.prefix import ordinal


def _rank(df: DataFrame, strata: Sequence[str], id_col: str, salt: Sequence, name: str) -> DataFrame:
    key = F.md5(F.concat(F.col(id_col).cast("string"), *[F.col(s).cast("string") if isinstance(s, str) and s in df.columns
                                                         else F.lit(str(s)) for s in salt]))
    return ordinal(df.withColumn("_key", key), list(strata), "_key", name=name).drop("_key")


def stratified_split(df: DataFrame, group_cols: Sequence[str] = ("category",), label: str = "label", id_col: str = "id",
                     test_size: float = 0.1, seed: int = 100) -> DataFrame:
    """K1/K2: ``train`` = 0 for the first ``round(test_size · n)`` rows of each (group, label)
    stratum in hash order, 1 for the rest; -1 where the label is not 0/1."""
    g = list(group_cols)
    labelled = df.where(F.col(label).isin(0, 1))
    ranked = _rank(labelled, [*g, label], id_col, [*g, seed], "_r")
    sizes = labelled.groupBy(*g, label).agg(F.count(F.lit(1)).alias("_n"))
    r = ranked.join(sizes, [*g, label])
    r = r.withColumn("train", F.when(F.col("_r") <= F.round(F.lit(test_size) * F.col("_n")), 0).otherwise(1)).drop("_r", "_n")
    rest = df.where(~F.col(label).isin(0, 1) | F.col(label).isNull()).withColumn("train", F.lit(-1))
    return r.unionByName(rest)


def stratified_kfold(df: DataFrame, group_cols: Sequence[str] = ("category",), label: str = "label", id_col: str = "id",
                     k: int = 10, seed: int = 100, train_col: str = "train") -> DataFrame:
    """K3: folds 1..k over all labelled rows (second, independently salted order), then test rows
    (``train == 0``) set to 0; unlabelled rows -1."""
    g = list(group_cols)
    labelled = df.where(F.col(label).isin(0, 1))
    ranked = _rank(labelled, [*g, label], id_col, [*g, seed, "kfold"], "_r2")
    fold = F.pmod(F.col("_r2") - 1, F.lit(k)) + 1
    if train_col in df.columns:
        fold = F.when(F.col(train_col) == 0, F.lit(0)).otherwise(fold)
    r = ranked.withColumn("fold", fold.cast("int")).drop("_r2")
    rest = df.where(~F.col(label).isin(0, 1) | F.col(label).isNull()).withColumn("fold", F.lit(-1))
    return r.unionByName(rest)
