"""Row predicates and label rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def interval_overlap(s1, e1, s2, e2) -> Column:
    """Half-open spans ``[s1,e1)`` and ``[s2,e2)`` overlap; an empty span never overlaps."""
    s1, e1, s2, e2 = map(_c, (s1, e1, s2, e2))
    return (e1 > s1) & (e2 > s2) & (s1 < e2) & (s2 < e1)


def binarize(score, threshold, strict: bool = False) -> Column:
    """``score >= t`` (or ``score > t`` when strict) as int."""
    s, t = _c(score), threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (s > t if strict else s >= t).cast("int")


# Significance levels and their marks.
STAR_LEVELS: tuple[tuple[float, str], ...] = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def significance_stars(p) -> Column:
    """``***`` < .001, ``**`` < .01, ``*`` < .05, else ``-``."""
    p = _c(p)
    out = F.when(p < STAR_LEVELS[0][0], STAR_LEVELS[0][1])
    for lvl, mark in STAR_LEVELS[1:]:
        out = out.when(p < lvl, mark)
    return out.otherwise("-")


def tristate_label(count, seen) -> Column:
    """1 if count >= 1; 0 if seen >= 1; else -1 (not seen)."""
    return F.when(_c(count) >= 1, 1).when(_c(seen) >= 1, 0).otherwise(-1)


def twostate_label(count) -> Column:
    """1 if count >= 1 else 0."""
    return F.when(_c(count) >= 1, 1).otherwise(0)


def none_label(*counts) -> Column:
    """1 iff the largest of the category counts is 0."""
    return (F.greatest(*[_c(c) for c in counts]) == 0).cast("int")


def top_n_mask(arr, n: int = 10) -> Column:
    """Per element, 1 if it is >= the n-th largest value of the array (all when shorter)."""
    a = _c(arr)
    nth = F.element_at(F.sort_array(a, asc=False), F.least(F.size(a), F.lit(n)))
    return F.transform(a, lambda v: (v >= nth).cast("int"))
