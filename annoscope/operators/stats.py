"""Statistical tests on aggregated rows. Aggregate first (one row per test),
then closed forms; p-values use the Arrow pandas UDFs of ``functions.dist`` on those few rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from annoscope.functions.dist import chi2_survival, two_sided_normal_p, two_sided_t_p
from annoscope.functions.predicates import significance_stars
from annoscope.operators.prefix import running_totals
from annoscope.session import per_group, written


def norm_ppf(q: float) -> float:
    """Standard normal quantile (bisection on erfc; a driver-side scalar of a parameter)."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < q:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def contingency(df: DataFrame, group_cols: Sequence[str], row: str, col: str) -> DataFrame:
    """2×2 table ``n{row}{col}`` of two 0/1 columns, one row per group."""
    r, c = F.col(row), F.col(col)
    return df.groupBy(*group_cols).agg(
        F.count_if((r == 0) & (c == 0)).alias("n00"), F.count_if((r == 0) & (c == 1)).alias("n01"),
        F.count_if((r == 1) & (c == 0)).alias("n10"), F.count_if((r == 1) & (c == 1)).alias("n11"))


def odds_ratio(table: DataFrame, ci: float = 0.95, log: bool = False, with_p: bool = True) -> DataFrame:
    """OR = n11·n00/(n10·n01), log-OR, SE, Wald CI and two-sided p. A zero cell gives NULLs."""
    n = [F.col(c).cast("double") for c in ("n00", "n01", "n10", "n11")]
    nonzero = (n[0] > 0) & (n[1] > 0) & (n[2] > 0) & (n[3] > 0)
    orv = F.when(nonzero, (n[3] * n[0]) / (n[2] * n[1]))
    lor = F.log(orv)
    se = F.when(nonzero, F.sqrt(1 / n[0] + 1 / n[1] + 1 / n[2] + 1 / n[3]))
    z = abs(norm_ppf((1 - ci) / 2))
    out = table.select("*", orv.alias("odds_ratio"), lor.alias("log_or"), se.alias("se"),
                       F.exp(lor - z * se).alias("ci_lower"), F.exp(lor + z * se).alias("ci_upper"),
                       (F.abs(lor) / se).alias("z"))
    if log:
        out = out.withColumn("odds_ratio", F.log("odds_ratio")).withColumn("ci_lower", F.log("ci_lower")) \
            .withColumn("ci_upper", F.log("ci_upper"))
    if with_p:
        out = out.withColumn("p_value", F.when(F.col("z").isNotNull(), two_sided_normal_p(F.col("z"))))
    return out


def conditional_prob(table: DataFrame) -> DataFrame:
    """P(col = 1 | row = 1) = n11 / (n10 + n11)."""
    return table.withColumn("cond_prob", F.try_divide(F.col("n11").cast("double"), (F.col("n10") + F.col("n11")).cast("double")))


def chi2_2x2(table: DataFrame, with_p: bool = True) -> DataFrame:
    """Pearson χ² of a 2×2 table without continuity correction (1 df) + stars."""
    n00, n01, n10, n11 = (F.col(c).cast("double") for c in ("n00", "n01", "n10", "n11"))
    tot = n00 + n01 + n10 + n11
    den = (n00 + n01) * (n10 + n11) * (n00 + n10) * (n01 + n11)
    chi2 = F.when(den > 0, tot * F.pow(n00 * n11 - n01 * n10, 2) / den)
    out = table.select("*", chi2.alias("chi2"))
    if with_p:
        out = out.withColumn("p_value", F.when(F.col("chi2").isNotNull(), chi2_survival(F.col("chi2"), F.lit(1.0))))
        out = out.withColumn("stars", significance_stars("p_value"))
    return out


def ttest_ind(df: DataFrame, group_cols: Sequence[str], value: str, sample: str, with_p: bool = True) -> DataFrame:
    """Two-sample t-test with pooled variance; ``sample`` is 1 for the first sample, 0 for the
    second. ``(group..., n1, n2, mean1, mean2, t, df[, p_value])``."""
    s, v = F.col(sample), F.col(value).cast("double")
    a = df.groupBy(*group_cols).agg(
        F.count(F.when(s == 1, v)).alias("n1"), F.count(F.when(s == 0, v)).alias("n2"),
        F.avg(F.when(s == 1, v)).alias("mean1"), F.avg(F.when(s == 0, v)).alias("mean2"),
        F.var_samp(F.when(s == 1, v)).alias("_v1"), F.var_samp(F.when(s == 0, v)).alias("_v2"))
    dof = F.col("n1") + F.col("n2") - 2
    sp2 = ((F.col("n1") - 1) * F.col("_v1") + (F.col("n2") - 1) * F.col("_v2")) / dof
    t = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(sp2 * (1.0 / F.col("n1") + 1.0 / F.col("n2"))))
    out = a.select(*group_cols, "n1", "n2", "mean1", "mean2", t.alias("t"), dof.cast("double").alias("df"))
    if with_p:
        out = out.withColumn("p_value", F.when(F.col("t").isNotNull(), two_sided_t_p(F.col("t"), F.col("df"))))
    return out


def average_ranks(df: DataFrame, group_cols: Sequence[str], value: str) -> DataFrame:
    """H2: average (mid) rank of each distinct value in its group, distributed:
    ``(group..., value, c, rank)`` with rank = (# smaller) + (c + 1)/2."""
    g = list(group_cols)
    counts = df.groupBy(*g, F.col(value).cast("double").alias("_val")).agg(F.count(F.lit(1)).alias("c"))
    cum = running_totals(counts, g, "_val", ["c"])
    return cum.select(*g, F.col("_val").alias(value), "c", (F.col("cum_c") - F.col("c") + (F.col("c") + 1) / 2.0).alias("rank"))


def mann_whitney(df: DataFrame, group_cols: Sequence[str], value: str, sample: str, with_p: bool = True) -> DataFrame:
    """Mann–Whitney U of the first sample (``sample`` = 1) with tie-corrected, continuity-
    corrected normal p (two-sided), plus the medians of both samples."""
    g = list(group_cols)
    # one row per distinct value with the counts of both samples; one running total over both
    # gives average ranks, ties and both medians
    first, second = F.col(sample) == 1, F.col(sample) == 0
    per = df.where(F.col(value).isNotNull()).groupBy(*g, F.col(value).cast("double").alias("_v")).agg(
        F.count_if(first).alias("c1"), F.count_if(second).alias("c0"), F.count(F.lit(1)).alias("c"))
    cum = written(running_totals(per, g, "_v", ["c1", "c0", "c"]), "ranks")
    sizes = per_group(cum.groupBy(*g).agg(F.sum("c1").alias("_s1"), F.sum("c0").alias("_s0")))
    j = cum.join(sizes, g) if g else cum.crossJoin(sizes)
    rank = F.col("cum_c") - F.col("c") + (F.col("c") + 1) / 2.0

    def median(i: int):
        at = lambda k: F.min(F.when(F.col(f"cum_c{i}") >= k, F.col("_v")))
        return (at(F.floor((F.col(f"_s{i}") + 1) / 2)) + at(F.floor(F.col(f"_s{i}") / 2) + 1)) / 2

    a = j.groupBy(*g).agg(F.sum(F.col("c1") * rank).alias("R1"), F.sum("c1").alias("n1"), F.sum("c").alias("n"),
                          F.sum(F.pow(F.col("c"), 3) - F.col("c")).alias("ties"),
                          median(1).alias("median1"), median(0).alias("median2"))
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    n2 = n - n1
    u1 = F.col("R1") - n1 * (n1 + 1) / 2
    mu = n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    u = F.greatest(u1, n1 * n2 - u1)
    z = F.try_divide(u - mu - 0.5, sigma)
    out = a.select(*g, F.col("n1").alias("n1"), (F.col("n") - F.col("n1")).alias("n2"), u1.alias("U"), z.alias("z"), "median1", "median2")
    if with_p:
        # U is the larger of U1, U2, so z < 0 only within the continuity correction: p clips to 1
        out = out.withColumn("p_value", F.when(F.col("z") < 0, F.lit(1.0))
                             .when(F.col("z").isNotNull(), two_sided_normal_p(F.col("z"))))
    return out
