import numpy as np
import pandas as pd
import pytest

from annoscope.operators import curves as C, threshold as T

# 12-row scorer with ties and a negative at the top (the NaN-F1 vertex case)
Y = [0, 1, 1, 0, 1, 0, 0, 1, 0, 1, 0, 0]
S = [0.95, 0.9, 0.9, 0.8, 0.7, 0.7, 0.5, 0.4, 0.3, 0.3, 0.2, 0.1]


def np_roc(y, s, drop=True):
    order = np.argsort(-np.asarray(s), kind="mergesort")
    ys, ss = np.asarray(y)[order], np.asarray(s)[order]
    idx = np.r_[np.where(np.diff(ss))[0], len(ss) - 1]
    tps, fps, thr = np.cumsum(ys)[idx], 1 + idx - np.cumsum(ys)[idx], ss[idx]
    if drop and len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps, thr = fps[keep], tps[keep], thr[keep]
    return np.r_[0, fps] / fps[-1], np.r_[0, tps] / tps[-1], np.r_[np.inf, thr]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(pd.DataFrame({"g": "a", "y_true": Y, "y_score": S}))


def test_roc_vertices_and_auc(scored):
    fpr, tpr, thr = np_roc(Y, S)
    v = C.roc_vertices(scored, ["g"]).toPandas().sort_values("k")
    assert np.allclose(v.fpr, fpr) and np.allclose(v.tpr, tpr) and np.allclose(v.threshold, thr)
    auc = C.auc_roc(scored, ["g"]).first().auc
    assert abs(auc - np.trapezoid(tpr, fpr)) < 1e-12
    # rank-sum form
    r = pd.Series(S).rank().values
    n1, n0 = sum(Y), len(Y) - sum(Y)
    assert abs(auc - (r[np.array(Y) == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) < 1e-12


def test_roc_interpolation_matches_numpy(scored):
    fpr, tpr, _ = np_roc(Y, S, drop=False)
    grid = np.linspace(0, 1, 100)
    exp = np.interp(grid, fpr, tpr)
    exp[-1] = 1.0
    got = C.roc_interpolated(scored, ["g"]).toPandas().sort_values("i")
    assert len(got) == 100 and np.allclose(got.tpr.values, exp)


def test_pr_interpolation_and_area(scored):
    order = np.argsort(-np.asarray(S), kind="mergesort")
    ys, ss = np.asarray(Y)[order], np.asarray(S)[order]
    idx = np.r_[np.where(np.diff(ss))[0], len(ss) - 1]
    tps = np.cumsum(ys)[idx]
    fps = 1 + idx - tps
    last = tps.searchsorted(tps[-1])
    prec = np.r_[1.0, (tps / (tps + fps))[: last + 1]]
    rec = np.r_[0.0, (tps / tps[-1])[: last + 1]]
    exp = np.interp(np.linspace(0, 1, 100), rec, prec)
    exp[0] = 1.0
    got = C.pr_interpolated(scored, ["g"]).toPandas().sort_values("i")
    assert np.allclose(got.precision.values, exp)
    area = C.auc_pr(scored, ["g"]).first().auc_pr
    assert abs(area - np.trapezoid(prec, rec)) < 1e-12


def test_max_f1_threshold_nan_vertex_is_zero(scored):
    r = T.max_f1_threshold(scored, ["g"]).first()
    # the top vertex (0.95) is a negative: precision = recall = 0 -> F1 defined as 0, never chosen
    assert r.f1 > 0 and r.threshold != 0.95


def test_median_prediction_and_metrics(scored):
    p = C.median_predictions(scored, ["g"])
    m = C.binary_metrics(C.confusion(p, ["g"])).first()
    med = np.median(S)
    pred = (np.array(S) >= med).astype(int)
    tp = int(((pred == 1) & (np.array(Y) == 1)).sum())
    assert m.tp == tp and abs(m.accuracy - (pred == np.array(Y)).mean()) < 1e-12


def test_mean_sd_ci(spark):
    vals = [0.7, 0.8, 0.75, 0.9, 0.65, 0.72, 0.81, 0.77, 0.69, 0.74]
    df = spark.createDataFrame([("a", v) for v in vals], "g string, v double")
    r = C.mean_sd_ci(df, ["g"], "v").first()
    m, sd, se = np.mean(vals), np.std(vals), np.std(vals, ddof=1) / np.sqrt(10)
    assert abs(r.mean - m) < 1e-12 and abs(r.sd_upper - (m + sd)) < 1e-12
    assert abs(r.ci_upper - (m + 2.262157162798239 * se)) < 1e-9


def test_reliability_bins_numpy_edges(spark):
    p = [0.0, 0.1, 0.3, 0.30000000000000004, 0.95, 1.0]
    df = spark.createDataFrame([(1, x) for x in p], "y_true int, y_score double")
    got = sorted(r.bin for r in df.select(C.calibration_bin("y_score", 10).alias("bin")).collect())
    edges = np.linspace(0, 1, 11)
    assert got == sorted(np.searchsorted(edges[1:-1], p).tolist())


def test_metric_matrix_is_wide_rounded_and_keeps_missing_pairs(spark):
    from annoscope.operators.curves import metric_matrix

    rows = [("care", "en", 0.123456), ("care", "de", 0.5), ("loyalty", "en", 0.987), ("loyalty", None, 0.1)]
    out = metric_matrix(spark.createDataFrame(rows, "category string, corpus string, auc double"), "category", "corpus", "auc")
    assert out.columns == ["category", "de", "en"]
    assert {r["category"]: (r["de"], r["en"]) for r in out.collect()} == {"care": (0.5, 0.12), "loyalty": (None, 0.99)}
