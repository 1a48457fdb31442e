"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated.

Each text gives a vector of statistics (shares of byte classes, word lengths, repetition of words, word pairs and
lines). Standardised with the training rows' moments, it is mapped to ``features`` random Fourier features
cos(w x + b), which approximate a Gaussian kernel. The normal equations are summed per task, then over
tasks by Spark, and only their fixed-size sums (features^2) reach the driver. Two halves of the training rows are
summed apart: each half is scored by the other's solution, and isotonic regression over a fixed
grid of these out-of-fold scores calibrates the solution of all rows.

Labels are the only outside input: doc_id, lang and source never enter a score. Texts are read whole; all
labelled rows that are not held out are used.

Defined cases: a null text is an empty one, and its statistics are 0; labels that are null or whose document is missing are not
used; of repeated labels of an id the largest counts, and rows that repeat an id are scored each for
itself; with no usable label the score is 0.5, with one class it is that class's smoothed share; a
null id is hashed as an empty string.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from annoscope.llm import _text as tx
from annoscope.session import written as saved

FEATURES, RIDGE, SCALE, GRID = 256, 1.0, 1.0, 1024

_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".", b",;:", b"!?",
            b"|", b"#$%&*", b"\"'`()[]{}", b"<>=/\\+-_@^~", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0)))
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _bytes in enumerate(_CLASSES):
    _CLASS[list(_bytes)] = _i
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[0x0A] = True
N_STATS = len(_CLASSES) + 1 + 11


def _repeats(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the share of distinct values, and the share of the most frequent one."""
    n = np.diff(first)
    docs = len(n)
    distinct, top = np.zeros(docs), np.zeros(docs)
    if len(hashes):
        key = np.sort(tx.doc_of(first).astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
        at = tx.segment_starts(key)
        size = np.diff(np.append(at, len(key)))
        doc = (key[at] >> np.uint64(40)).astype(np.int64)
        distinct = np.bincount(doc, minlength=docs).astype(float)
        some = tx.segment_starts(doc)
        top[doc[some]] = np.maximum.reduceat(size, some)
    n = np.maximum(n, 1)
    return distinct / n, top / n


def statistics(text: pa.Array) -> np.ndarray:
    """One row of ``N_STATS`` numbers for each text."""
    data, offsets = tx.utf8(text)
    docs = len(offsets) - 1
    length = np.diff(offsets)
    per_byte = np.repeat(np.arange(docs), length)
    shares = np.bincount(per_byte * (len(_CLASSES) + 1) + _CLASS[data], minlength=docs * (len(_CLASSES) + 1)).reshape(docs, -1)
    shares = shares / np.maximum(length, 1)[:, None]
    start, end, first = tx.word_spans(data, offsets)
    n, doc, size = np.diff(first), tx.doc_of(first), (end - start).astype(float)
    one = np.maximum(n, 1)
    mean = np.bincount(doc, size, docs) / one
    spread = np.sqrt(np.maximum(np.bincount(doc, size**2, docs) / one - mean**2, 0))
    words = tx.span_hashes(data, start, end)
    distinct, top = _repeats(words, first)
    pairs, valid = tx.gram_hashes(words, first, 2)
    pair_first = np.concatenate([[0], np.cumsum(valid)])[first]
    pair_distinct, pair_top = _repeats(pairs[valid], pair_first)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    adjacent = np.bincount(doc, same, docs) / one
    symbol = (_CLASS[data[end - 1]] >= 7) & (_CLASS[data[end - 1]] <= 11) if len(end) else np.zeros(0, bool)
    ends = np.bincount(doc, symbol, docs) / one
    l_start, l_end, l_first = tx.word_spans(data, offsets, _NEWLINE)
    lines = np.diff(l_first)
    line_distinct, _ = _repeats(tx.span_hashes(data, l_start, l_end), l_first)
    columns = [np.log1p(n), mean, spread, distinct, top, pair_distinct, pair_top, adjacent, ends, np.log1p(n / np.maximum(lines, 1)), line_distinct]
    return np.concatenate([shares, np.stack(columns, axis=1)], axis=1)


@dataclass
class Model:
    """A fitted classifier; ``weights`` is empty when the labels tell nothing."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]
    constant: float = 0.5

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        z = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.constant)
        return np.interp(self.features(x) @ self.weights, *self.knots)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.values.to_numpy(zero_copy_only=False), float).reshape(len(col), N_STATS) if len(col) else np.zeros((0, N_STATS))


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_STATS, pa.int32()), pa.array(x.reshape(-1), pa.float64()))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.slices(batch):
            yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), _vectors(statistics(part.column("text")))], ["doc_id", "stats"])


def described(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stats) of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_describe, "doc_id long, stats array<double>")


def fold(doc_id: Column, of: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def _summed(rows: DataFrame, work, names: int) -> dict[int, np.ndarray]:
    """``work`` turns a batch (stats, y, half) into ``names`` named vectors, which are added over all batches and
    tasks; what reaches the driver has a fixed size."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in work(_matrix(batch.column("stats")), np.asarray(batch.column("y").to_numpy(zero_copy_only=False), float),
                             batch.column("half").to_numpy(zero_copy_only=False)).items():
                total[k] = total[k] + v if k in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["k", "v"])

    def add(table: pa.Table) -> pa.Table:
        v = np.sum([np.frombuffer(b, float) for b in table.column("v").to_pylist()], axis=0)
        return pa.table({"k": pa.array([table.column("k")[0].as_py()], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

    got = rows.mapInArrow(local, "k int, v binary").groupBy("k").applyInArrow(lambda t: add(t), "k int, v binary").collect()
    assert len(got) <= names
    return {r["k"]: np.frombuffer(bytes(r["v"]), float) for r in got}


def _isotonic(x: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over grid cells; knots at both ends of each pool."""
    pools: list[list[float]] = []
    for xi, t, c in zip(x, total, count):
        pools.append([xi, xi, t, c])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, high, t, c = pools.pop()
            pools[-1] = [pools[-1][0], high, pools[-1][2] + t, pools[-1][3] + c]
    ends = [(e, (p[2] + 0.5) / (p[3] + 1.0)) for p in pools for e in ((p[0], p[1]) if p[0] < p[1] else (p[0],))]
    # half a row of each class keeps the scores of pure pools inside (0, 1); the values must not fall for that
    return np.array([e for e, _ in ends]), np.maximum.accumulate(np.array([v for _, v in ends]))


def fit(stats: DataFrame, labels: DataFrame, label: str, train: Column, features: int = FEATURES, ridge: float = RIDGE, scale: float = SCALE,
        doc_id: str = "doc_id") -> Model:
    """Fit on the labelled rows of ``stats`` (doc_id, stats) for which ``train`` holds."""
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    rows = stats.where(train).join(marks, "doc_id").select("stats", "y", (F.xxhash64("doc_id") % 2 == 0).cast("int").alias("half"))
    rows = saved(rows, "quality-train")
    moments = _summed(rows, lambda x, y, h: {0: np.concatenate([[len(y), y.sum()], x.sum(0), (x**2).sum(0)])}, 1).get(0, np.zeros(2 + 2 * N_STATS))
    n, good = moments[0], moments[1]
    mean = moments[2:2 + N_STATS] / max(n, 1)
    spread = np.sqrt(np.maximum(moments[2 + N_STATS:] / max(n, 1) - mean**2, 0))
    spread[spread < 1e-9] = 1.0
    rng = np.random.default_rng(17)
    model = Model(mean, spread, rng.normal(size=(N_STATS, features)) / (scale * np.sqrt(N_STATS)), rng.uniform(0, 2 * np.pi, features),
                  np.zeros(0), (np.zeros(0), np.zeros(0)), float((good + 1) / (n + 2)))
    if good == 0 or good == n:
        return model
    width = features + 1

    def normal(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        for h in (0, 1):
            z, t = model.features(x[half == h]), y[half == h]
            for i, row in enumerate(np.concatenate([z.T @ z, (z.T @ t)[:, None]], axis=1)):
                out[h * width + i] = row
        return out

    sums = _summed(rows, normal, 2 * width)
    halves = [np.stack([sums[h * width + i] for i in range(width)]) for h in (0, 1)]
    solve = lambda m: np.linalg.solve(m[:, :width] + ridge * np.eye(width), m[:, width])
    apart, model.weights = [solve(m) for m in halves], solve(halves[0] + halves[1])
    low, high = -0.5, 1.5

    def cells(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> dict[int, np.ndarray]:
        z = model.features(x)
        s = np.where(half == 0, z @ apart[1], z @ apart[0])
        cell = np.clip(((s - low) / (high - low) * GRID).astype(int), 0, GRID - 1)
        return {0: np.concatenate([np.bincount(cell, y, GRID), np.bincount(cell, minlength=GRID)])}

    total, count = _summed(rows, cells, 1)[0].reshape(2, GRID)
    some = count > 0
    centre = low + (np.arange(GRID) + 0.5) * (high - low) / GRID
    model.knots = _isotonic(centre[some], total[some], count[some])
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, stats)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(_matrix(batch.column("stats"))), pa.float64())], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, doc_id: str = "doc_id", text: str = "text",
             threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; labels of held-out rows (crc32 of the id) are not used."""
    stats = saved(described(docs, doc_id, text), "quality-stats")
    model = fit(stats, labels, label, fold(F.col("doc_id"), folds) != held_out)
    out = scored(stats, model)
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, doc_id: str = "doc_id",
              text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``threshold``; nothing is shuffled by id."""
    stats = saved(described(docs, doc_id, text), "quality-stats")
    shared = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, label, fold(F.col("doc_id"), folds) != held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in tx.slices(pa.table({"text": batch.column(text)})):
                good = shared.value.score(statistics(part.column("text"))) >= threshold
                yield batch.slice(at, part.num_rows).filter(pa.array(good))
                at += part.num_rows

    return docs.mapInArrow(run, docs.schema)
