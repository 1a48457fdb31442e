"""Array-vector expressions (E6 and L2 normalisation); higher-order functions, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a, b) -> Column:
    """Cosine similarity; NULL when either vector has zero norm."""
    den = l2_norm(a) * l2_norm(b)
    return F.when(den > 0, dot(a, b) / den)


def l2_normalize(a) -> Column:
    """Unit vector; the zero vector stays zero."""
    n = l2_norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda v: v.cast("double") / n)).otherwise(
        F.transform(_c(a), lambda v: v.cast("double") * 0.0))
