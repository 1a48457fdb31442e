import math

import numpy as np
import pytest

from annoscope.llm.whitening import leading, leading_values, sturm_counts, tridiagonal, whiten


def plain(vectors):
    """The contract in exact integers and NumPy's own solver."""
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    z = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    e, u = np.linalg.eigh(z.T @ z / n)
    return [i for i, _ in kept], deviation, z, e[::-1], u.T[::-1]


def test_solver_matches_lapack_also_in_clusters():
    rng = np.random.default_rng(3)
    spectra = [rng.uniform(0, 5, 40), np.array([3.0] * 5 + [1.0] * 20), np.array([2, 2 - 1e-12, 2 - 2e-12, 1, 0, 0.0]), np.array([7.0]), np.array([1e-9, 4.0]), np.zeros(4)]
    for spectrum in spectra:
        q, _ = np.linalg.qr(rng.normal(size=(len(spectrum),) * 2))
        a = q @ np.diag(spectrum) @ q.T
        a = (a + a.T) / 2
        values, vectors = leading(a, 8)
        k = len(values)
        assert k == min(8, len(a))
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-13 * max(1, spectrum.max()))
        assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-12)
        assert np.allclose(a @ vectors.T, vectors.T * values, atol=1e-12 * max(1, spectrum.max()))


def test_sturm_counts_and_bisection_on_a_split_matrix():
    a = np.diag([4.0, 1.0, 1.0, -2.0])
    d, off, _ = tridiagonal(a)
    assert sturm_counts(d, off, np.array([-3.0, 0.0, 2.0, 5.0])).tolist() == [0, 1, 3, 4]
    assert np.allclose(leading_values(d, off, 4), [4, 1, 1, -2])


def test_rows_match_the_plain_computation(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12)
    vectors = [(int(i), [float(c) for c in row]) for i, row in enumerate(base)]
    vectors += [(5, vectors[5][1]), (None, vectors[7][1]), (900, None), (901, [float("nan")] * 12), (902, [1.0] * 11 + [None]), (903, [float("inf")] * 12)]
    table = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, component string").repartition(5)
    got = whiten(table).collect()
    ids, deviation, z, e, u = plain(vectors)
    assert len(got) == 8 * len(ids)
    assert {r["n"] for r in got} == {len(ids)}
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == sorted((str(i), d) for i, d in zip(ids, deviation))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    for c in range(8):
        share = {r["explained"] for r in got if r["component"] == c + 1}
        assert len(share) == 1 and share.pop() == pytest.approx(e[c] / e.sum(), rel=1e-10)
        w = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c + 1}
        want = dict(zip(ids, z @ u[c] / math.sqrt(e[c])))
        sign = 1 if w[0] * want[0] > 0 else -1
        assert all(w[i] == pytest.approx(sign * want[i], abs=1e-9) for i in want)


def test_few_dimensions_constant_vectors_other_lengths_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    one = whiten(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    line = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [9.0]), (4, [2.0, 2.0])], schema)).collect()
    assert {r["vec_id"] for r in line} == {1, 2, 4}
    assert sorted(round(abs(r["whitened"]), 6) for r in line if r["component"] == 1) == [0.0, 1.224745, 1.224745]
    assert all(r["whitened"] is None for r in line if r["component"] == 2)


def test_large_entries_stay_exact(spark):
    vectors = [(i, [1e9 * i, -1e10, 3.0 + i]) for i in range(6)]
    got = whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    _, deviation, _, _, _ = plain(vectors)
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: (d if d < 2**63 else None) for i, d in enumerate(deviation)}
