"""Embedding whitening: components of a distributed centred covariance, and the projection on them.

Each entry c of a vector becomes the integer x = floor(1024 c) + 100000. One pass over the table finds the number n
of vectors and the exact sums S, a second adds up the products of the centred entries x - S/n within each task
and then by pair of dimensions in Spark. The covariance (dimensions², whatever the number of vectors) is solved on the
driver: Householder reflections make it tridiagonal, bisection on Sturm counts finds the leading eigenvalues, inverse
iteration finds their vectors, which are reorthogonalised within clusters of close eigenvalues and reflected
back. A third pass projects every vector on the broadcast components; its result is written once, as it is also needed
for the covariance of the whitened values.

Defined cases: vectors that are null or hold null or non-finite entries are dropped, and so are vectors of another
length than the commonest (of equally common lengths the longest; empty vectors never count). Null and repeated ids are
rows like any other. A component without variance (eigenvalue within rounding of 0) has explained 0 or next to it and a
null whitened value, and does not count for the identity error, which is null if no component is left. ``deviation`` is null
where it exceeds a long. Entries beyond 2**51 in size count as that. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annoscope.llm import _text as tx
from annoscope.session import written

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
_FAR = 2.0**61
_LONG = 2**63
_CLOSE = 1e-3  # eigenvalues nearer than this share of the norm form a cluster
_EPS = float(np.finfo(float).eps)


# ---- vectors of a batch ----
def _blocks(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries, start, length) of the list column; length is -1 for null lists and for those with null or
    non-finite entries."""
    offsets = np.asarray(col.offsets.to_numpy(), np.int64)
    values = np.asarray(col.values.to_numpy(zero_copy_only=False), float)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    start, end = offsets[:-1], offsets[1:]
    good = (wrong[end] == wrong[start]) & col.is_valid().to_numpy(zero_copy_only=False)
    return values, start, np.where(good, end - start, -1)


def _integers(values: np.ndarray, start: np.ndarray, dim: int) -> np.ndarray:
    """The x-vectors that begin at ``start``, one a row."""
    entries = values[start[:, None] + np.arange(dim)]
    return np.clip(np.floor(SCALE * entries), -_FAR, _FAR).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length of vector and dimension: how many vectors, and their sum in two halves (exact)."""
    found: dict[int, list] = {}
    for batch in batches:
        values, start, length = _blocks(batch.column("vec"))
        for dim in np.unique(length[length > 0]).tolist():
            x = _integers(values, start[length == dim], dim)
            kept = found.setdefault(dim, [0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)])
            kept[0] += len(x)
            kept[1] += (x >> 32).sum(0)
            kept[2] += (x & 0xFFFFFFFF).sum(0)
    for dim, (n, high, low) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n)), pa.array(high), pa.array(low)],
            ["dim", "i", "n", "high", "low"])
    tx.release()


class Centre:
    """The number of vectors and their mean S / n, kept exactly as quotient and remainder."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.dim = n, len(sums)
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum (n x - S)² of every row, exactly: n² sum y² - 2 n sum r y + sum r² with y = x - whole, r the remainders."""
        y = x - self.whole
        far = np.abs(y.astype(float)).max(initial=0.0)
        if self.dim * far * max(far, float(self.n)) < 2.0**62:
            squares, mixed = (y * y).sum(1).tolist(), (y * np.array(self.rest, np.int64)).sum(1).tolist()
        else:
            rows = y.tolist()
            squares = [sum(v * v for v in row) for row in rows]
            mixed = [sum(r * v for r, v in zip(self.rest, row)) for row in rows]
        n, last = self.n, sum(r * r for r in self.rest)
        exact = (n * n * a - 2 * n * b + last for a, b in zip(squares, mixed))
        return [v if v < _LONG else None for v in exact]


def _products(centre: Centre):
    """Per task, the sum of the products of centred entries, a row for each pair of dimensions i <= j."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((centre.dim, centre.dim))
        for batch in batches:
            values, start, length = _blocks(batch.column("vec"))
            z = centre.centred(_integers(values, start[length == centre.dim], centre.dim))
            total += z.T @ z
        if total.any():
            i, j = np.triu_indices(centre.dim)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])
        tx.release()

    return run


# ---- leading eigenvectors ----
def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors): the symmetric matrix after Householder reflections from both sides."""
    a, reflectors = np.array(a, float), []
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v[1:])
        if size == 0:
            reflectors.append(np.zeros(len(v)))
            continue
        goal = -np.copysign(np.hypot(v[0], size), v[0])
        v[0] -= goal
        v /= np.linalg.norm(v)
        p = 2 * (a[k + 1:, k + 1:] @ v)
        w = p - (v @ p) * v
        a[k + 1:, k + 1:] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k] = goal
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each number of ``at``."""
    least = np.finfo(float).tiny * max(1.0, float((off**2).max(initial=0.0))) / _EPS
    count, q = np.zeros(len(at), int), np.ones(len(at))
    for i in range(len(diagonal)):
        q = diagonal[i] - at - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling, by bisection to the last bits."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    bottom, top = (diagonal - reach).min(), (diagonal + reach).max()
    slack = 4 * _EPS * max(abs(bottom), abs(top)) + np.finfo(float).tiny
    low, high = np.full(most, bottom - slack), np.full(most, top + slack)
    wanted = n - 1 - np.arange(most)  # eigenvalues below the k-th largest
    while True:
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        above = sturm_counts(diagonal, off, middle) > wanted
        high, low = np.where(above, middle, high), np.where(above, low, middle)


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) y = b by elimination with row exchanges; pivots below ``least`` count as that."""
    n = len(diagonal)
    d, up, up2, b = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, b.tolist()
    for i in range(n - 1):
        low = float(off[i])
        if abs(d[i]) >= abs(low):
            if abs(d[i]) < least:
                d[i] = least
            f = low / d[i]
            d[i + 1] -= f * up[i]
            b[i + 1] -= f * b[i]
        else:
            f = d[i] / low
            d[i], d[i + 1], up[i] = low, up[i] - f * d[i + 1], d[i + 1]
            up2[i], up[i + 1] = up[i + 1], -f * up[i + 1]
            b[i], b[i + 1] = b[i + 1], b[i] - f * b[i + 1]
    if abs(d[-1]) < least:
        d[-1] = least
    y = [0.0] * n
    for i in range(n - 1, -1, -1):
        y[i] = (b[i] - (up[i] * y[i + 1] if i + 1 < n else 0.0) - (up2[i] * y[i + 2] if i + 2 < n else 0.0)) / d[i]
    return np.array(y)


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one a row, by inverse iteration; a vector is made orthogonal to the
    earlier ones of its cluster in each step, and equal eigenvalues are set apart by a few last bits."""
    n, rng = len(diagonal), np.random.default_rng(1)
    norm = float(np.max(np.abs(diagonal), initial=0) + 2 * np.max(np.abs(off), initial=0)) or 1.0
    out, cluster, before = np.zeros((len(values), n)), 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > _CLOSE * norm:
            cluster = k
        shift = min(float(value), before - 10 * _EPS * norm) if k > cluster else float(value)
        before, y = shift, rng.uniform(-1, 1, n)
        for _ in range(6):
            for near in out[cluster:k]:
                y -= (near @ y) * near
            y = _solved(diagonal, off, shift, y / np.linalg.norm(y), _EPS * norm)
            y /= np.abs(y).max()
        for _ in range(2):
            for near in out[cluster:k]:
                y -= (near @ y) * near
            y /= np.linalg.norm(y)
        out[k] = y
    return out


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as rows) of a symmetric matrix."""
    most, size = min(most, len(v)), float(np.abs(v).max(initial=0))
    if not most or not size:
        return np.zeros(most), np.eye(len(v))[:most]
    diagonal, off, reflectors = tridiagonal(v / size)
    values = leading_values(diagonal, off, most)
    vectors = leading_vectors(diagonal, off, values).T
    for k in range(len(reflectors) - 1, -1, -1):
        r = reflectors[k]
        vectors[k + 1:] -= 2 * np.outer(r, r @ vectors[k + 1:])
    return values * size, vectors.T


# ---- the passes over the table ----
def _project(centre: Centre, components: np.ndarray, scales: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, start, length = _blocks(batch.column("vec"))
            rows = np.flatnonzero(length == centre.dim)
            x = _integers(values, start[rows], centre.dim)
            w = centre.centred(x) @ components.T
            flat = pa.array(np.divide(w, scales, out=np.zeros_like(w), where=scales > 0).reshape(-1), mask=np.tile(scales <= 0, len(rows)))
            w_list = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(scales), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(centre.deviations(x), pa.int64()), w_list], ["id", "deviation", "w"])
        tx.release()

    return run


def _identity_error(projected: DataFrame, live: list[int]) -> float | None:
    """The largest absolute entry of the covariance of the whitened values minus the identity."""
    if not live:
        return None
    means = projected.agg(*[F.avg(F.col("w")[k]).alias(f"m{k}") for k in live]).first()
    part = {k: F.col("w")[k] - F.lit(means[f"m{k}"]) for k in live}
    pairs = [(i, j) for i in live for j in live if i <= j]
    cov = projected.agg(*[F.avg(part[i] * part[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row for each vector and each of the
    leading ``components``, numbered from 1."""
    spark, id_type = vectors.sparkSession, vectors.schema[vec_id].dataType.simpleString()
    rows = vectors.select(F.col(embedding).cast("array<double>").alias("vec"))
    sums = written(rows.mapInArrow(_sums, "dim int, i int, n long, high long, low long"), "whitening-sums")
    best = sums.where("i = 0").groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if best is None:
        return spark.createDataFrame([], f"{vec_id} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    per_dim = sums.where(F.col("dim") == best["dim"]).groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    centre = Centre(int(best["n"]), [(r["high"] << 32) + r["low"] for r in sorted(per_dim, key=lambda r: r["i"])])

    pairs = rows.mapInArrow(_products(centre), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    v = np.zeros((centre.dim, centre.dim))
    i, j = pairs.column("i").to_numpy(), pairs.column("j").to_numpy()
    v[i, j] = v[j, i] = pairs.column("v").to_numpy() / centre.n
    values, axes = leading(v, components)
    trace = float(np.trace(v))
    some = values > centre.dim * _EPS * trace
    scales = np.sqrt(np.where(some, values, 0.0))
    explained = [max(float(e), 0.0) / trace if trace else 0.0 for e in values]

    both = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("vec"))
    projected = written(both.mapInArrow(_project(centre, axes, scales), f"id {id_type}, deviation long, w array<double>"), "whitened")
    error = _identity_error(projected, np.flatnonzero(some).tolist())
    each = projected.select(F.col("id").alias(vec_id), "deviation", F.posexplode("w").alias("at", "whitened"))
    share = F.array(*[F.lit(e) for e in explained])
    return each.select(vec_id, (F.col("at") + 1).cast("int").alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation", "whitened",
                       share[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
