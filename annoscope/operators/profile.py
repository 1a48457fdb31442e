"""Corpus profiles and distribution summaries.

Quantiles use the distributed exact selection; densities collapse values to distinct
``(group, value, count)`` rows first, then evaluate a fixed grid per distinct value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from annoscope.operators.prefix import exact_percentiles
from annoscope.session import per_group


def _pivot_probs(q: DataFrame, g: list[str], names: dict[float, str]) -> DataFrame:
    aggs = [F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in names.items()]
    return q.groupBy(*g).agg(*aggs)


def describe(df: DataFrame, group_cols: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (linear), max."""
    g = list(group_cols)
    base = df.groupBy(*g).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                              F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"))
    q = exact_percentiles(df, g, value, probs=[0.25, 0.5, 0.75])
    qs = _pivot_probs(q, g, {0.25: "q25", 0.5: "q50", 0.75: "q75"})
    return base.join(qs, g) if g else base.crossJoin(qs)


def mean_ci(df: DataFrame, group_cols: Sequence[str], value: str, confidence: float = 0.95, total_label: str = "all") -> DataFrame:
    """Mean with the t confidence interval per group plus an overall row (``rollup``)."""
    from annoscope.functions.dist import t_quantile

    g = list(group_cols)
    a = df.rollup(*g).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"), F.count(value).alias("n"),
                          *[F.grouping(c).alias(f"_all_{c}") for c in g])
    # a NULL group stays NULL; only rollup's own totals get the label
    a = a.select(*[F.when(F.col(f"_all_{c}") == 1, F.lit(total_label)).otherwise(F.col(c).cast("string")).alias(c) for c in g], "mean", "n", "_sd")
    half = t_quantile(F.lit((1 + confidence) / 2), (F.col("n") - 1).cast("double")) * F.col("_sd") / F.sqrt("n")
    return a.select(*g, "n", "mean", (F.col("mean") - half).alias("ci_lower"), (F.col("mean") + half).alias("ci_upper"))


def positive_rate(labels: DataFrame, group_cols: Sequence[str], label: str = "label", total_col: str | None = None,
                  total_label: str = "all") -> DataFrame:
    """Share of positives, −1 counted as 0, denominator all rows; ``total_col`` gets an
    overall row via ``rollup``."""
    g = list(group_cols)
    pos = F.avg(F.greatest(F.col(label), F.lit(0)).cast("double")).alias("pos_rate")
    if total_col is None:
        return labels.groupBy(*g).agg(pos)
    keep = [c for c in g if c != total_col]
    r = labels.rollup(*keep, total_col).agg(pos, F.grouping_id().alias("_gid"))
    r = r.where(F.col("_gid") <= 1)  # drop rollup levels above total_col
    return r.select(*keep, F.when(F.col("_gid") == 1, F.lit(total_label)).otherwise(F.col(total_col)).alias(total_col), "pos_rate")


def histogram(df: DataFrame, group_cols: Sequence[str], value: str, bins: int) -> DataFrame:
    """Equal bins on [0, 1]; 1.0 goes to the last bin. ``n`` and probability ``n / N``."""
    g = list(group_cols)
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    h = df.groupBy(*g, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    tot = df.groupBy(*g).agg(F.count(F.lit(1)).alias("_N"))
    h = h.join(tot, g) if g else h.crossJoin(tot)
    return h.select(*g, "bin", "n", (F.col("n") / F.col("_N")).alias("prob"))


def box_stats(df: DataFrame, group_cols: Sequence[str], value: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles (linear), IQR, whiskers at the most extreme values within ``whisker``·IQR
    of the box, and the number of outliers."""
    g = list(group_cols)
    q = per_group(_pivot_probs(exact_percentiles(df, g, value, probs=[0.25, 0.5, 0.75]), g, {0.25: "q1", 0.5: "median", 0.75: "q3"}))
    j = df.join(q, g) if g else df.crossJoin(q)
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - whisker * iqr, F.col("q3") + whisker * iqr
    v = F.col(value)
    return j.groupBy(*g, "q1", "median", "q3").agg(
        F.min(F.when(v >= lo, v)).alias("whisker_lo"), F.max(F.when(v <= hi, v)).alias("whisker_hi"),
        F.count_if((v < lo) | (v > hi)).alias("n_outliers"), F.count(F.lit(1)).alias("n"))


_KDE_CELLS, _KDE_REACH, _KDE_ORDER = 8, 9, 6  # cells a bandwidth; bandwidths to a grid point; moments of a cell


def kde_grid(df: DataFrame, group_cols: Sequence[str], value: str, n_grid: int = 101, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Gaussian KDE with Scott's bandwidth (n^(-1/5) · sample sd) at ``n_grid`` points of [lo, hi].

    Values are summed up in cells of an eighth of their group's bandwidth, as powers of the distance d to the cell's centre; a cell
    then meets the grid points within 9 bandwidths, where exp(-(t - d)²/2) is expanded in Hermite polynomials up to d^5. Rows
    never meet the grid, and the table of cells does not grow with the rows. With |d| at most 1/16 a kernel is off by
    2.4e-9 of its peak at most, so a density by 2.4e-9 / (bandwidth · √2π). A group without spread has no bandwidth and NULL
    densities; a group without values has no rows."""
    g = list(group_cols)
    v = F.col(value).cast("double")
    base = df.where(v.isNotNull())
    stats = base.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(v).alias("_sd"))
    stats = per_group(stats.withColumn("_bw", F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * F.col("_sd")).drop("_sd"))
    spread = stats.where("_bw > 0").select(*[F.col(c).alias(f"_g_{c}") for c in g], F.col("_bw").alias("_b"))
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in g]
    rows = base.join(spread, same) if g else base.crossJoin(F.broadcast(spread))  # one row
    width = F.col("_b") / _KDE_CELLS
    rows = rows.select(*g, "_b", F.floor(v / width).alias("_cell"), ((v / F.col("_b")) * _KDE_CELLS).alias("_at"))
    d = (F.col("_at") - F.col("_cell") - 0.5) / _KDE_CELLS
    cells = rows.groupBy(*g, "_b", "_cell").agg(*[F.sum(F.pow(d, F.lit(float(k)))).alias(f"_m{k}") for k in range(_KDE_ORDER)])
    step = (hi - lo) / (n_grid - 1)
    centre = (F.col("_cell") + 0.5) * width
    first = F.greatest(F.ceil((centre - _KDE_REACH * F.col("_b") - lo) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((centre + _KDE_REACH * F.col("_b") - lo) / step), F.lit(n_grid - 1)).cast("int")
    near = cells.withColumn("_c", centre).withColumn("_i0", first).withColumn("_i1", last).where("_i0 <= _i1").withColumn("i", F.explode(F.sequence("_i0", "_i1")))
    t = (F.lit(lo) + F.col("i") * F.lit(step) - F.col("_c")) / F.col("_b")
    near = near.withColumn("_t", t)
    he, series = [F.lit(1.0), F.col("_t")], F.lit(0.0)
    for k in range(_KDE_ORDER):
        if k > 1:
            he.append(F.col("_t") * he[k - 1] - (k - 1) * he[k - 2])
        series = series + he[k] * F.col(f"_m{k}") / math.factorial(k)
    sums = near.groupBy(*[F.col(c).alias(f"_g_{c}") for c in g], F.col("i").alias("_gi")).agg(F.sum(F.exp(-F.col("_t") * F.col("_t") / 2) * series).alias("_s"))
    spine = stats.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))))
    out = spine.join(sums, [*same, F.col("i") == F.col("_gi")], "left")
    norm = F.col("_n") * F.col("_bw") * F.lit(math.sqrt(2 * math.pi))
    return out.select(*g, "i", (F.lit(lo) + F.col("i") * F.lit(step)).alias("x"),
                      F.when(F.col("_bw") > 0, F.coalesce("_s", F.lit(0.0)) / norm).alias("density"))
