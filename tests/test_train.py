"""Training against a NumPy Newton solver: coefficients, hard-label metric, best C, out-of-fold and test scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annoscope.operators import train as TR

NAMES = ("care", "fairness")


def newton(x, y, c, steps=200):
    x = np.c_[np.ones(len(x)), x]
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1 / c)
    ridge[0] = 0

    def objective(v):
        z = x @ v
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * ridge @ v**2

    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-12), g)
        t = 1.0
        while objective(w - t * step) > objective(w) and t > 1e-8:
            t /= 2
        w = w - t * step
        if abs(g @ step) < 1e-12:
            break
    return w


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(220, 4))
    ys = np.stack([(x[:, 0] + 0.8 * rng.normal(size=220) > 0), (x[:, 1] - x[:, 2] + rng.normal(size=220) > 0.5)], axis=1).astype(int)
    return x, ys, rng.integers(0, 4, 220)


@pytest.fixture(scope="module")
def data(spark, table):
    x, ys, fold = table
    rows = [(i, [float(v) for v in x[i]], [int(v) for v in ys[i]], int(fold[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "id long, vec array<double>, ys array<int>, fold int").repartition(3)


def test_models_match_numpy(data, table):
    x, ys, fold = table
    specs = [TR.Model(k, c, f) for k in range(2) for c in (1e3, 1.0, 1e-2, 1e-6) for f in (0, 2)]
    for m in TR.fit_models(data, specs):
        on = (fold > 0) & (fold != m.fold)
        assert m.weights == pytest.approx(newton(x[on], ys[on, m.category], m.C), abs=1e-4)


def test_groups_of_models_do_not_change_the_result(data, monkeypatch):
    specs = lambda: [TR.Model(0, c, 0) for c in (10.0, 1.0, 0.1)]
    whole = [m.weights for m in TR.fit_models(data, specs())]
    monkeypatch.setattr(TR, "PASS_BYTES", 1)
    assert np.allclose(whole, [m.weights for m in TR.fit_models(data, specs())])


def test_spark_ml_model_has_the_same_optimum(data, table):
    one = TR.prepare(data.withColumn("y", F.col("ys")[0]))
    w = TR.fit_models(data, [TR.Model(0, 2.0, 0)])[0].weights
    m = TR.fit_logreg(one.where("fold > 0"), 2.0)
    assert [m.intercept, *m.coefficients.toArray()] == pytest.approx(w.tolist(), abs=1e-4)


def test_grid_best_c_and_scores(data, table):
    x, ys, fold = table
    c_range = (1e2, 1.0, 1e-3)
    models = TR.cv_models(data, NAMES, c_range)
    grid = TR.cv_grid(data, models, NAMES)
    want = {}
    for k in range(2):
        for c in c_range:
            for f in (1, 2, 3):
                on, off = (fold > 0) & (fold != f), fold == f
                w = newton(x[on], ys[on, k], c)
                p, t = np.c_[np.ones(off.sum()), x[off]] @ w > 0, ys[off, k] == 1
                want[(NAMES[k], c, f)] = (off.sum(), ((p & t).sum() / t.sum() + (~p & ~t).sum() / (~t).sum()) / 2, w)
    got = {(r.category, r.C, r.fold): (r.n_valid, r.metric) for r in grid.collect()}
    assert got == {k: (v[0], pytest.approx(v[1])) for k, v in want.items()}
    mean = {(k, c): sum(want[(k, c, f)][0] * want[(k, c, f)][1] for f in (1, 2, 3)) / sum(want[(k, c, f)][0] for f in (1, 2, 3))
            for k in NAMES for c in c_range}
    best = {k: max(c_range, key=lambda c: (round(mean[(k, c)], 12), c)) for k in NAMES}
    assert {r.category: r.C for r in TR.best_c(grid).where("is_best = 1").collect()} == best
    for r in TR.out_of_fold(data, models, grid, NAMES).collect():
        k = NAMES.index(r.category)
        c = max(c_range, key=lambda c: (want[(r.category, c, r.fold)][1], c))
        z = np.r_[1, x[r.id]] @ want[(r.category, c, r.fold)][2]
        assert r.y_true == ys[r.id, k] and r.y_score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)
    final = TR.final_models(data, grid, NAMES)
    scored = TR.score_models(data, final, NAMES).collect()
    assert len(scored) == 2 * (fold == 0).sum() and {r.fold for r in scored} == {0}
    on = fold > 0
    for r in scored:
        k = NAMES.index(r.category)
        z = np.r_[1, x[r.id]] @ newton(x[on], ys[on, k], best[r.category])
        assert r.y_score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
