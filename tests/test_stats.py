import math

import numpy as np

from annoscope.operators import stats as ST


def test_odds_ratio_zero_cell_is_null(spark):
    t = spark.createDataFrame([(10, 0, 5, 7), (20, 10, 5, 15)], "n00 long, n01 long, n10 long, n11 long")
    r = ST.odds_ratio(t).collect()
    assert r[0].odds_ratio is None and r[0].p_value is None
    o = (15 * 20) / (5 * 10)
    se = math.sqrt(1 / 20 + 1 / 10 + 1 / 5 + 1 / 15)
    assert abs(r[1].odds_ratio - o) < 1e-12
    assert abs(r[1].p_value - math.erfc(abs(math.log(o)) / se / math.sqrt(2))) < 1e-12
    assert abs(r[1].ci_lower - math.exp(math.log(o) - 1.959963984540054 * se)) < 1e-9


def test_chi2_matches_closed_form_and_p(spark):
    t = spark.createDataFrame([(20, 10, 5, 15)], "n00 long, n01 long, n10 long, n11 long")
    r = ST.chi2_2x2(t).first()
    n = 50
    exp = n * (20 * 15 - 10 * 5) ** 2 / (30 * 20 * 25 * 25)
    assert abs(r.chi2 - exp) < 1e-12
    assert abs(r.p_value - math.erfc(math.sqrt(exp / 2))) < 1e-9
    assert r.stars == "***" if r.p_value < 0.001 else True


def test_mann_whitney_against_manual(spark):
    x = [1.0, 2.0, 2.0, 5.0, 7.0]
    y = [2.0, 3.0, 4.0, 4.0, 6.0, 8.0]
    df = spark.createDataFrame([("g", v, 1) for v in x] + [("g", v, 0) for v in y], "g string, v double, s int")
    r = ST.mann_whitney(df, ["g"], "v", "s").first()
    allv = np.array(x + y)
    ranks = np.array([(allv < v).sum() + ((allv == v).sum() + 1) / 2 for v in allv])
    u1 = ranks[: len(x)].sum() - len(x) * (len(x) + 1) / 2
    assert abs(r.U - u1) < 1e-12
    n1, n2, n = len(x), len(y), len(allv)
    _, c = np.unique(allv, return_counts=True)
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - (c ** 3 - c).sum() / (n * (n - 1))))
    z = (max(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sigma
    assert abs(r.z - z) < 1e-12
    assert abs(r.p_value - min(1.0, math.erfc(z / math.sqrt(2)))) < 1e-9
    assert r.median1 == 2.0 and r.median2 == 4.0


def test_ttest_pooled(spark):
    a = [1, 0, 1, 1, 0, 1]
    b = [0, 0, 1, 0, 0]
    df = spark.createDataFrame([("g", v, 1) for v in a] + [("g", v, 0) for v in b], "g string, v int, s int")
    r = ST.ttest_ind(df, ["g"], "v", "s").first()
    n1, n2 = len(a), len(b)
    sp2 = ((n1 - 1) * np.var(a, ddof=1) + (n2 - 1) * np.var(b, ddof=1)) / (n1 + n2 - 2)
    t = (np.mean(a) - np.mean(b)) / math.sqrt(sp2 * (1 / n1 + 1 / n2))
    assert abs(r.t - t) < 1e-12 and r.df == 9
    assert 0 < r.p_value < 1
