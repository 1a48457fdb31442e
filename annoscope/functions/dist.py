"""Distribution functions (S6) as Arrow-batched pandas UDFs.

Spark has no ``erf``, t or chi-square distribution. These run only on aggregated rows (one row per
test), so the Python cost is per group, never per input row. Formulas are the standard ones:
normal tail via ``math.erfc``; Student t via the regularised incomplete beta function (continued
fraction); chi-square survival via the regularised upper incomplete gamma function.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def _betacf(a: float, b: float, x: float) -> float:
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_sf(t: float, df: float) -> float:
    """P(T > t) for Student t with df degrees of freedom."""
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    tail = 0.5 * betainc(df / 2.0, 0.5, df / (df + t * t))
    return tail if t > 0 else 1.0 - tail


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student t (bisection on t_sf; monotone, 1e-13 relative)."""
    if not (0.0 < p < 1.0) or df <= 0:
        return float("nan")
    if p == 0.5:
        return 0.0
    lo, hi = -1.0, 1.0
    while 1.0 - t_sf(lo, df) > p:
        lo *= 2.0
    while 1.0 - t_sf(hi, df) < p:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if 1.0 - t_sf(mid, df) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-14 * max(1.0, abs(mid)):
            break
    return 0.5 * (lo + hi)


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    if x < a + 1.0:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(1000):
            ap += 1.0
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 3e-16:
                break
        return 1.0 - s * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < 3e-16:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, df: float) -> float:
    if math.isnan(x) or df <= 0:
        return float("nan")
    return gammaincc(df / 2.0, x / 2.0)


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _vec(fn):
    def run(*series: pd.Series) -> pd.Series:
        cols = [s.to_numpy(dtype="float64", na_value=np.nan) for s in series]
        out = [fn(*vals) if not any(v is None or (isinstance(v, float) and math.isnan(v)) for v in vals)
               else float("nan") for vals in zip(*cols)]
        return pd.Series(out, dtype="float64").replace({np.nan: None})
    return run


@F.pandas_udf(T.DoubleType())
def two_sided_normal_p(z: pd.Series) -> pd.Series:
    """p = erfc(|z| / sqrt 2)."""
    return _vec(lambda v: math.erfc(abs(v) / math.sqrt(2.0)))(z)


@F.pandas_udf(T.DoubleType())
def two_sided_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(lambda v, d: 2.0 * t_sf(abs(v), d))(t, df)


@F.pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(t_ppf)(p, df)


@F.pandas_udf(T.DoubleType())
def chi2_survival(x: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(chi2_sf)(x, df)
