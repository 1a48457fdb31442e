"""Ordered prefix computations without a single-partition window.

A ``Window.partitionBy(group).orderBy(x)`` puts a whole group in one task. With a hot group (a
third of all rows) and high-cardinality ``x`` that task does not finish. Here the ordered rows are
range-partitioned on ``(group, x)`` so a group spans many tasks; each task computes local running
sums over its slice (window keyed by the task's partition id, so each window partition is bounded
by the range-partition size), the per-slice totals (at most ``partitions + groups`` rows) give
each slice an offset, and one join adds it. The input is expected to be *collapsed* to one row per
``(group, x)`` first (``groupBy`` with map-side partial aggregation), so ties never straddle slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from annoscope.session import per_group, written

_PID = "_slice"
#: Accuracy of the quantile sketch (ranks within a 10,000th of the rows), and how far from a probability it is asked.
_ACCURACY, _MARGIN = 10_000, 3e-4
#: Groups of at most so many rows are counted whole: in these the margin is only a few rows.
_WHOLE = 1 << 15


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return int(partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def running_totals(df: DataFrame, group_cols: Sequence[str], order_col: str, sum_cols: Sequence[str],
                   descending: bool = False, partitions: int | None = None,
                   prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``sum_cols`` over ``order_col`` inside each group.

    ``(group, order_col)`` must be unique. Adds ``{prefix}{c}`` for each summed column.
    """
    g = list(group_cols)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    ranged = df.repartitionByRange(_partitions(df, partitions), *[F.col(c) for c in g], order)
    # The slice id must be identical for the two consumers below (local sums and slice totals).
    # Range bounds come from sampling the input, whose row order may differ between two
    # executions, so the sliced rows are written once, with their slice id, and both consumers read
    # that table.
    sliced = written(ranged.withColumn(_PID, F.spark_partition_id()), "slices")
    w_local = Window.partitionBy(_PID, *g).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(c).over(w_local).alias(f"_loc_{c}") for c in sum_cols])
    totals = sliced.groupBy(_PID, *g).agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    w_off = Window.partitionBy(*g).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PID, *g, *[F.coalesce(F.sum(f"_tot_{c}").over(w_off), F.lit(0)).alias(f"_off_{c}")
                                        for c in sum_cols])
    joined = local.join(offsets, on=[_PID, *g], how="inner")
    out_cols = [F.col(c) for c in df.columns] + [
        (F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"{prefix}{c}") for c in sum_cols]
    return joined.select(*out_cols)


def ordinal(df: DataFrame, group_cols: Sequence[str], order_col: str, descending: bool = False,
            name: str = "k", partitions: int | None = None) -> DataFrame:
    """1-based position of each row in its group by ``order_col`` (unique per group)."""
    one = "_one_"
    out = running_totals(df.withColumn(one, F.lit(1).cast("long")), group_cols, order_col, [one],
                         descending=descending, partitions=partitions, prefix="_cum")
    return out.withColumnRenamed(f"_cum{one}", name).drop(one)


def with_next(df: DataFrame, group_cols: Sequence[str], key: str, cols: Sequence[str],
              suffix: str = "_next") -> DataFrame:
    """Distributed ``lead``: attach ``cols`` of the row whose ``key`` is one larger (equi-join)."""
    nxt = df.select(*group_cols, (F.col(key) - 1).alias(key), *[F.col(c).alias(c + suffix) for c in cols])
    return df.join(nxt, on=[*group_cols, key], how="left")


def with_prev(df: DataFrame, group_cols: Sequence[str], key: str, cols: Sequence[str],
              suffix: str = "_prev") -> DataFrame:
    """Distributed ``lag`` by an equi-join on ``key + 1``."""
    prv = df.select(*group_cols, (F.col(key) + 1).alias(key), *[F.col(c).alias(c + suffix) for c in cols])
    return df.join(prv, on=[*group_cols, key], how="left")


def exact_percentiles(df: DataFrame, group_cols: Sequence[str], value_col: str, probs: Sequence[float] | None = None,
                      probs_df: DataFrame | None = None, prob_col: str = "prob", out_col: str = "value",
                      partitions: int | None = None) -> DataFrame:
    """Exact linear-interpolation percentiles (NumPy's default) by order-statistic selection.

    No group is ever held in one task. With ``probs`` (fractions in [0, 1]) a quantile sketch first gives each group two
    values around each probability; rows between them are counted value by value, rows below them as one number, and other
    rows not at all, so only these few rows are shuffled. Where the wanted positions turn out not to lie between the two,
    and with ``probs_df(group..., prob)``, all values are counted: ``(group, value, n)``. Running counts then give each
    distinct value its position range, and the wanted positions are found by an equi-join on the group plus a range predicate (at
    most two target rows per probability and group). Returns ``(group..., prob, value)``.
    """
    g = list(group_cols)
    base = df.where(F.col(value_col).isNotNull()).select(*g, F.col(value_col).cast("double").alias("_v"))
    if probs_df is None:
        probs = list(dict.fromkeys(float(p) for p in probs))
        # null groups have no result: the joins below do not match them
        base = written(base.dropna(subset=g) if g else base, "values")
        sizes = _around(base, g, probs)
        targets = _positions(sizes.select(*g, "_N", F.explode(F.array(*[F.lit(p) for p in probs])).alias(prob_col)), g, prob_col)
        key, counts = [*g, prob_col], _near_counts(base, sizes, g, probs, prob_col)
        if _missed(targets, counts, key):
            key, counts = g, _counts(base, g)
    else:
        key, counts = g, _counts(base, g)
        sizes = per_group(counts.groupBy(*g).agg(F.sum("_n").alias("_N")))
        targets = _positions(sizes.join(probs_df, on=g, how="inner") if g else sizes.crossJoin(probs_df), g, prob_col)
    cum = running_totals(counts, key, "_v", ["_n"], partitions=partitions)
    cum = cum.select(*key, "_v", (F.col("cum__n") - F.col("_n")).alias("_lo_pos"), (F.col("cum__n") - 1).alias("_hi_pos"))
    pos = targets.select(*g, prob_col, "_h", "_p0", F.explode(F.array_distinct(F.array("_p0", "_p1"))).alias("_p"))
    cum_r = cum.select(*[F.col(c).alias(f"_c_{c}") for c in key], "_v", "_lo_pos", "_hi_pos")
    cond = [F.col("_p") >= F.col("_lo_pos"), F.col("_p") <= F.col("_hi_pos")]
    cond += [F.col(c) == F.col(f"_c_{c}") for c in key]
    hit = per_group(pos).join(cum_r, on=cond, how="inner").select(*g, prob_col, "_h", "_p0", "_p", "_v")
    res = hit.groupBy(*g, prob_col, "_h", "_p0").agg(
        F.min_by("_v", "_p").alias("_v0"), F.max_by("_v", "_p").alias("_v1"))
    frac = F.col("_h") - F.col("_p0")
    return res.select(*g, prob_col, (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * frac).alias(out_col))


def _counts(base: DataFrame, g: list[str]) -> DataFrame:
    return written(base.groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_n")), "values")


def _positions(sizes: DataFrame, g: list[str], prob_col: str) -> DataFrame:
    """The two positions from 0 around each probability of groups of ``_N`` rows."""
    h = F.col(prob_col) * (F.col("_N") - 1)
    return sizes.select(*g, prob_col, "_N", h.alias("_h"), F.floor(h).cast("long").alias("_p0"), F.ceil(h).cast("long").alias("_p1"))


def _around(base: DataFrame, g: list[str], probs: list[float]) -> DataFrame:
    """Per group its number of rows and, for each probability, a value below and one above it, by a sketch."""
    asked = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-_MARGIN, _MARGIN)]
    return per_group(base.groupBy(*g).agg(F.count(F.lit(1)).alias("_N"), F.percentile_approx("_v", asked, _ACCURACY).alias("_q")))


def _near_counts(base: DataFrame, sizes: DataFrame, g: list[str], probs: list[float], prob_col: str) -> DataFrame:
    """Counts of the values between the two of ``_around``, for each probability; the rows below are the null value's. Small
    groups are counted whole."""
    ends = F.array(*[F.struct(F.lit(p).alias(prob_col), F.col("_q")[2 * i].alias("_lo"), F.col("_q")[2 * i + 1].alias("_hi")) for i, p in enumerate(probs)])
    rows = (base.join(sizes, g) if g else base.crossJoin(F.broadcast(sizes))).select(*g, "_v", (F.col("_N") <= _WHOLE).alias("_all"), F.explode(ends).alias("_r"))
    rows = rows.where(F.col("_all") | (F.col("_v") <= F.col("_r._hi")))
    value = F.when(F.col("_all") | (F.col("_v") >= F.col("_r._lo")), F.col("_v"))
    return written(rows.select(*g, F.col("_r")[prob_col].alias(prob_col), value.alias("_v")).groupBy(*g, prob_col, "_v").agg(F.count(F.lit(1)).alias("_n")), "near")


def _missed(targets: DataFrame, counts: DataFrame, key: list[str]) -> bool:
    """Whether a wanted position is not among the values of ``_near_counts``."""
    below = F.sum(F.when(F.col("_v").isNull(), F.col("_n")).otherwise(0))
    got = counts.groupBy(*key).agg(below.alias("_under"), F.sum("_n").alias("_upto"))
    found = (F.col("_under") <= F.col("_p0")) & (F.col("_p1") < F.col("_upto"))
    return not targets.where(F.col("_N") > 0).join(got, key, "left").where(~F.coalesce(found, F.lit(False))).isEmpty()
