"""Interval-overlap join by binning.

Half-open spans ``[start, end)`` are exploded into the fixed-width character bins they touch and
equi-joined on ``(keys..., bin)``. A pair that shares several bins is kept only in the first bin
both touch (``greatest`` of the two start bins), so no de-duplication shuffle is needed. Work per
key is proportional to the spans' lengths / ``bin_size`` — never all pairs of a document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from annoscope.functions.predicates import interval_overlap


def _binned(df: DataFrame, start: str, end: str, bin_size: int, tag: str) -> DataFrame:
    b0 = F.floor(F.col(start) / bin_size).cast("long")
    b1 = F.floor((F.col(end) - 1) / bin_size).cast("long")
    return df.where(F.col(end) > F.col(start)).select("*", b0.alias(f"_b0{tag}"),
                                                       F.explode(F.sequence(b0, b1)).alias("_bin"))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str],
                 right_span: tuple[str, str], bin_size: int = 256) -> DataFrame:
    """Inner join of rows whose spans overlap (and whose ``keys`` are equal).

    Column names of the two sides must be disjoint apart from ``keys``.
    """
    ls, le = left_span
    rs, re_ = right_span
    lb = _binned(left, ls, le, bin_size, "l")
    rb = _binned(right, rs, re_, bin_size, "r")
    j = lb.join(rb, on=[*keys, "_bin"], how="inner")
    first_common = F.greatest(F.col("_b0l"), F.col("_b0r"))
    j = j.where((F.col("_bin") == first_common) & interval_overlap(ls, le, rs, re_))
    return j.drop("_bin", "_b0l", "_b0r")
