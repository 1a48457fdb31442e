"""Sparse matrices against a plain dictionary; L-BFGS over a grid against a NumPy Newton solver on the dense matrix."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from annoscope.operators import sparse as SP, train as TR
from annoscope.operators.vectors import document_frequency, term_counts
from annoscope.session import written
from test_train import newton

NAMES = ("care", "fairness")


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(8)
    words = [f"w{k:02d}é" if k % 5 else f"W{k:02d}" for k in range(40)]
    docs = {i: [words[k] for k in rng.choice(40, rng.integers(0, 30), p=np.arange(1, 41)[::-1] / 820)] for i in range(150)}
    docs[150] = []
    return docs


@pytest.fixture(scope="module")
def matrix(spark, corpus):
    terms = spark.createDataFrame([(i, w) for i, ws in corpus.items() for w in ws], "id long, term string").repartition(4)
    ids = spark.createDataFrame([(i,) for i in corpus], "id long")
    tf = term_counts(terms)
    return SP.count_matrix(tf, document_frequency(tf, len(corpus), 5, 0.99), ids)


def dense(m, n):
    x = np.zeros((n, m.size))
    for r in m.rows.collect():
        assert r["indices"] == sorted(set(r["indices"]))
        x[r["id"], r["indices"]] = r["values"]
    return x


def test_matrix_and_dictionary_match_a_plain_count_and_survive_saving(spark, matrix, corpus, tmp_path):
    df = Counter(w for ws in corpus.values() for w in set(ws))
    vocab = sorted((w for w, n in df.items() if 5 <= n <= 0.99 * len(corpus)), key=lambda w: w.encode())
    for m in (matrix, (SP.save_matrix(matrix, str(tmp_path / "m")), SP.load_matrix(spark, str(tmp_path / "m")))[1]):
        assert m.size == len(vocab)
        assert [r["term"] for r in m.vocabulary.orderBy("term_id").collect()] == vocab
        assert sorted(r["term_id"] for r in m.vocabulary.collect()) == list(range(len(vocab)))
        want = np.array([[ws.count(w) for w in vocab] for ws in corpus.values()], float)
        assert (dense(m, len(corpus)) == want).all() and m.rows.count() == len(corpus)


def test_tfidf_matches_the_formula(matrix, corpus):
    x = dense(matrix, len(corpus))
    fit = np.arange(len(corpus)) % 3 > 0
    idf = SP.idf_weights(matrix, F.col("id") % 3 > 0)
    want = np.log((1 + fit.sum()) / (1 + (x[fit] > 0).sum(0))) + 1
    assert idf == pytest.approx(want)
    w = x * want
    norm = np.sqrt((w**2).sum(1, keepdims=True))
    assert dense(SP.tfidf_matrix(matrix, idf), len(corpus)) == pytest.approx(np.divide(w, norm, out=np.zeros_like(w), where=norm > 0))


@pytest.fixture(scope="module")
def training(spark, matrix, corpus):
    rng = np.random.default_rng(2)
    n = len(corpus)
    x = dense(SP.tfidf_matrix(matrix, SP.idf_weights(matrix, F.lit(True))), n)
    ys = np.stack([(x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=n) > 0), (x[:, 2] + 0.2 * rng.normal(size=n) > 0.1)], axis=1).astype(int)
    fold = rng.integers(0, 4, n)
    rows = [(i, [int(k) for k in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] != 0]], [int(v) for v in ys[i]], int(fold[i])) for i in range(n)]
    data = written(spark.createDataFrame(rows, "id long, indices array<int>, values array<double>, ys array<int>, fold int").repartition(3), "training")
    return data, x, ys, fold


def test_models_match_a_dense_newton_solver(training):
    data, x, ys, fold = training
    specs = [TR.Model(k, c, f) for k in range(2) for c in (1e4, 1.0, 1e-2, 1e-7) for f in (0, 2)]
    for m in SP.fit_sparse(data, x.shape[1], specs, max_steps=300, tol=1e-7):
        on = (fold > 0) & (fold != m.fold)
        want = newton(x[on], ys[on, m.category], m.C)
        assert m.weights == pytest.approx(want, abs=2e-3 * max(1.0, np.abs(want).max())), (m.category, m.C, m.fold, m.steps)


def test_groups_of_models_trees_of_sums_and_small_chunks_do_not_change_the_result(training, monkeypatch):
    data, x, _, _ = training
    specs = lambda: [TR.Model(0, c, 0) for c in (10.0, 1.0, 0.1)]
    whole = [m.weights for m in SP.fit_sparse(data, x.shape[1], specs(), tol=1e-8)]
    monkeypatch.setattr(SP, "PASS_BYTES", 1)
    monkeypatch.setattr(SP, "_TREE", 2)
    monkeypatch.setattr(SP, "DRIVER_BYTES", 1)
    monkeypatch.setattr(SP, "_WORK", 7)
    assert np.allclose(whole, [m.weights for m in SP.fit_sparse(data, x.shape[1], specs(), tol=1e-8)], atol=1e-4)


def test_a_model_that_is_done_makes_room_for_the_next(training, monkeypatch):
    data, x, _, _ = training
    summed, widths = SP._summed, []
    monkeypatch.setattr(SP, "PASS_BYTES", 2 * 8 * (x.shape[1] + 3))
    monkeypatch.setattr(SP, "_summed", lambda d, t, shape, work: widths.append(shape[1]) or summed(d, t, shape, work))
    SP.fit_sparse(data, x.shape[1], [TR.Model(k, c, 0) for k in range(2) for c in (1e3, 1e-6)], tol=1e-6)
    passes = widths[1:]  # the first call is for the curvatures
    assert passes[0] == 2 and passes == sorted(passes, reverse=True)


def test_grid_final_models_and_test_scores(training):
    data, x, ys, fold = training
    c_range = (1e2, 1.0, 1e-2)
    models, grid = SP.sparse_cv(data, x.shape[1], NAMES, c_range, tol=1e-8)
    for r in grid.collect():
        k = NAMES.index(r.category)
        on, off = (fold > 0) & (fold != r.fold), fold == r.fold
        p, t = np.c_[np.ones(off.sum()), x[off]] @ newton(x[on], ys[on, k], r.C) > 0, ys[off, k] == 1
        assert r.n_valid == off.sum() and r.metric == pytest.approx(((p & t).sum() / t.sum() + (~p & ~t).sum() / (~t).sum()) / 2)
    final = SP.sparse_final(data, x.shape[1], grid, NAMES, tol=1e-8)
    got = SP.sparse_scores(data, final, NAMES).collect()
    assert len(got) == 2 * (fold == 0).sum()
    for r in got:
        k = NAMES.index(r.category)
        z = np.r_[1, x[r.id]] @ newton(x[fold > 0], ys[fold > 0, k], final[k].C)
        assert (r.fold, r.y_true) == (0, ys[r.id, k]) and r.y_score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3)


def no_passes(*_):
    raise AssertionError("a pass over the table sends every model's gradient to the driver")


def test_a_grid_is_dealt_to_tasks_that_hold_the_rows(training, monkeypatch):
    data, x, _, _ = training
    c_range = (1.0, 1e-3)
    models, grid = SP.sparse_cv(data, x.shape[1], NAMES, c_range, tol=1e-7)
    one = {(m.category, m.C, m.fold): m for m in SP.fit_sparse(data, x.shape[1], [TR.Model(m.category, m.C, m.fold) for m in models], tol=1e-7)}
    for m in models:
        assert m.weights == pytest.approx(one[m.category, m.C, m.fold].weights, abs=1e-3)
    want = sorted(SP.sparse_cv_grid(data, models, NAMES).collect())
    assert sorted(grid.collect()) == want and len(want) == len(models) == 2 * 2 * 3
    monkeypatch.setattr(SP, "_summed", no_passes)
    monkeypatch.setattr(SP, "_TURNS", 1)
    monkeypatch.setattr(SP, "_WORK", 7)
    light, grid = SP.sparse_cv(data, x.shape[1], NAMES, c_range, weights=False, tol=1e-7)
    assert sorted(grid.collect()) == want and not any(len(m.weights) for m in light)


def test_rows_too_large_for_a_task_are_passed_over(training, monkeypatch):
    data, x, _, _ = training
    c_range = (1.0, 1e-3)
    want = sorted(SP.sparse_cv(data, x.shape[1], NAMES, c_range, tol=1e-7)[1].collect())
    monkeypatch.setattr(SP, "HELD_BYTES", 1000)
    monkeypatch.setattr(SP, "fit_apart", None)
    assert sorted(SP.sparse_cv(data, x.shape[1], NAMES, c_range, tol=1e-7)[1].collect()) == want


def test_a_step_that_is_too_long_does_not_ask_for_the_gradient():
    search = SP._Search(TR.Model(0, 1.0, 0), 2, 1e-9, np.ones(2), 10)
    assert search.tell(1.0, lambda: np.array([1.0, 1.0]), 1.0)
    far = search.trial
    assert search.tell(2.0, None, 1.0) and search.model.steps == 0 and (abs(search.trial) < abs(far)).all()


def test_no_rows_and_no_terms(spark, training):
    data, x, _, _ = training
    none = SP.fit_sparse(data.where("fold = 9"), x.shape[1], [TR.Model(0, 1.0, 0)])
    assert not none[0].weights.any()
    empty = spark.createDataFrame([(1, [], [], [1], 1), (2, [], [], [0], 1), (3, [], [], [1], 1)], "id long, indices array<int>, values array<double>, ys array<int>, fold int")
    m = SP.fit_sparse(empty, 0, [TR.Model(0, 1.0, 0)], tol=1e-9)[0]
    assert m.weights == pytest.approx([math.log(2)], abs=1e-6)
    m = [TR.Model(0, 1.0, 0)]
    SP.fit_apart(SP._packed(empty).rdd.coalesce(1), 0, m, tol=1e-9)
    assert m[0].weights == pytest.approx([math.log(2)], abs=1e-6)
    SP.fit_apart(SP._packed(empty.where("id > 3")).rdd.coalesce(1), 2, m)
    assert not m[0].weights.any() and len(m[0].weights) == 3


def test_final_models_are_dealt_to_tasks(training, monkeypatch):
    data, x, _, _ = training
    grid = SP.sparse_cv(data, x.shape[1], NAMES, (1.0, 1e-2), tol=1e-7)[1]
    monkeypatch.setattr(SP, "HELD_BYTES", 0)
    want = SP.sparse_final(data, x.shape[1], grid, NAMES, tol=1e-7)
    monkeypatch.setattr(SP, "HELD_BYTES", 1 << 20)
    monkeypatch.setattr(SP, "_summed", no_passes)
    got = SP.sparse_final(data, x.shape[1], grid, NAMES, tol=1e-7)
    for a, b in zip(want, got, strict=True):
        assert (a.category, a.C, a.fold) == (b.category, b.C, b.fold) and a.weights == pytest.approx(b.weights, rel=1e-4, abs=1e-4)
