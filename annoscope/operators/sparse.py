"""Sparse feature matrices and models on them.

A matrix is a table ``(id, indices, values)``, one row a document with ascending term ids, and its vocabulary ``(term,
term_id)``. The dictionary is made by rank: terms are range-partitioned and numbered slice by slice, so no list of terms
passes through the driver. Both tables are saved and loaded as Parquet.

L2 logistic regressions (½‖w‖² + C·Σ loss, intercept unpenalised) are fitted by L-BFGS. No square matrix of the vocabulary is
ever formed. There are two ways, with the same steps:

``fit_sparse`` fits a whole grid at once: one pass over the table per step gives the loss and gradient of every open model,
multiplied batch by batch in compressed rows, added up within each task, over groups of tasks where they are many, and on the
driver. The driver holds the recursion's state, a fixed number of vectors of the vocabulary's length for each open model; as
many are open as send at most ``PASS_BYTES`` from a task in a pass, and a model that is done makes room for the next.

``fit_apart`` deals the models to tasks. Each reads the train rows once, holds them and fits its models one after the other; no
gradient leaves a task. It takes tables of at most ``HELD_BYTES`` in a task's memory and enough models to keep the cores
busy; ``sparse_cv`` and ``sparse_final`` take the other way where that does not hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annoscope.operators.prefix import ordinal
from annoscope.operators.train import C_RANGE, Model, best_c
from annoscope.session import written

PASS_BYTES = 32 << 20
HELD_BYTES = 192 << 20  # train rows that a task holds
DRIVER_BYTES = 256 << 20  # partial sums that the driver adds up by itself
MEMORY = 10  # pairs of steps and gradient changes kept by the recursion
_WORK = 1 << 16  # entries multiplied at a time: their products stay in the processor's cache
_SEARCH_THREADS = 4  # searches that take their gradients at the same time
_TREE = 64  # partial sums added by one task
_TURNS = 4  # tasks a core that models are dealt to


# ---------------------------------------------------------------- matrices

@dataclass(frozen=True)
class SparseMatrix:
    """``rows`` (id, indices array<int>, values array<double>), ``vocabulary`` (term, term_id), and its size."""

    rows: DataFrame
    vocabulary: DataFrame
    size: int


def dictionary(terms: DataFrame, term: str = "term") -> DataFrame:
    """``(term, term_id)``: distinct terms numbered from 0 in code point order."""
    ranked = ordinal(terms.select(F.col(term).alias("term")), [], "term", name="_k")
    return ranked.select("term", (F.col("_k") - 1).cast("int").alias("term_id"))


def count_matrix(tf: DataFrame, vocab: DataFrame, ids: DataFrame) -> SparseMatrix:
    """The counts ``(id, term, count)`` of the terms of ``vocab`` as one sorted row for each of ``ids``; a document without
    any of the terms has an empty row."""
    known = written(dictionary(vocab), "vocabulary")  # written: its size is known when the join is planned
    cells = tf.join(known, "term").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term_id", F.col("count").cast("double").alias("value")))).alias("c"))
    rows = ids.select("id").join(cells, "id", "left").select(
        "id", F.coalesce("c.term_id", F.array().cast("array<int>")).alias("indices"), F.coalesce("c.value", F.array().cast("array<double>")).alias("values"))
    return SparseMatrix(rows, known, known.count())


def save_matrix(matrix: SparseMatrix, path: str) -> None:
    matrix.rows.write.mode("overwrite").parquet(f"{path}/rows")
    matrix.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")


def load_matrix(spark: SparkSession, path: str) -> SparseMatrix:
    """A saved matrix with its vocabulary."""
    vocabulary = spark.read.parquet(f"{path}/vocabulary")
    return SparseMatrix(spark.read.parquet(f"{path}/rows"), vocabulary, vocabulary.count())


def idf_weights(matrix: SparseMatrix, fit: Column) -> np.ndarray:
    """ln((1 + n) / (1 + df)) + 1 of every term, fitted on the rows where ``fit`` holds."""
    rows = matrix.rows.where(fit)
    n = rows.count()
    df = rows.select(F.explode("indices").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("df")).toArrow()
    count = np.zeros(matrix.size)
    count[df.column("i").to_numpy()] = df.column("df").to_numpy()
    return np.log((1 + n) / (1 + count)) + 1


def tfidf_matrix(matrix: SparseMatrix, idf: np.ndarray) -> SparseMatrix:
    """The rows times ``idf``, each scaled to length 1; an empty row stays empty."""
    given = matrix.rows.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, index, value = csr(batch)
            value = value * given.value[index]
            norm = np.sqrt(np.add.reduceat(np.append(value**2, 0.0), at[:-1]) * (np.diff(at) > 0)) if len(at) > 1 else np.zeros(0)
            value = value / np.repeat(np.where(norm > 0, norm, 1.0), np.diff(at))
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(at, index.astype(np.int32)), _lists(at, value)], ["id", "indices", "values"])

    id_type = matrix.rows.schema["id"].dataType.simpleString()
    rows = matrix.rows.select("id", "indices", "values").mapInArrow(run, f"id {id_type}, indices array<int>, values array<double>")
    return SparseMatrix(rows, matrix.vocabulary, matrix.size)


def _lists(at: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))


def csr(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, term ids, values) of a batch of rows."""
    col = batch.column("indices")
    at = np.concatenate([[0], np.cumsum(np.diff(col.offsets.to_numpy()))]).astype(np.int64)
    return at, col.flatten().to_numpy(zero_copy_only=False), np.asarray(batch.column("values").flatten().to_numpy(zero_copy_only=False), float)


# ---------------------------------------------------------------- products of a batch with the models

class _Chunk:
    """A few rows of a batch. Products go model by model: one model's vector stays in the processor's cache, rows of the
    matrix of all models do not."""

    def __init__(self, at: np.ndarray, index: np.ndarray, value: np.ndarray):
        self.n, self.index, self.value = len(at) - 1, index, value
        self.lengths = np.diff(at)
        self.some = np.flatnonzero(self.lengths)
        self.starts = at[:-1][self.some]

    def margins(self, w: np.ndarray) -> np.ndarray:
        """The rows times one model, its intercept first."""
        out = np.full(self.n, w[0])
        if len(self.some):
            x = w[1:].take(self.index)
            out[self.some] += np.add.reduceat(np.multiply(x, self.value, out=x), self.starts)
        return out

    def add_products(self, total: np.ndarray, r: np.ndarray) -> None:
        """Add the transposed rows times one model's residuals to ``total``."""
        total[0] += r.sum()
        if len(self.index):
            x = np.repeat(r, self.lengths)
            np.add.at(total[1:], self.index, np.multiply(x, self.value, out=x))

    def times(self, w: np.ndarray) -> np.ndarray:
        """rows x models: the margins, ``w`` with the intercepts first."""
        return np.stack([self.margins(w[:, k]) for k in range(w.shape[1])], axis=1) if w.shape[1] else np.zeros((self.n, 0))

    def add_left(self, total: np.ndarray, r: np.ndarray) -> None:
        """Add the transposed rows times ``r`` to ``total``."""
        for k in range(r.shape[1]):
            self.add_products(total[:, k], r[:, k])


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[slice, _Chunk]]:
    at, index, value = csr(batch)
    most, i = max(_WORK, 1), 0
    while i < batch.num_rows:
        j = min(max(int(np.searchsorted(at, at[i] + most, "right")) - 1, i + 1), i + most)
        yield slice(i, j), _Chunk(at[i:j + 1] - at[i], index[at[i]:at[j]].astype(np.intp), value[at[i]:at[j]])
        i = j


def _labels(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    y = np.asarray(batch.column("ys").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
    return y, batch.column("fold").to_numpy(zero_copy_only=False)


def _tree_sums(rows: DataFrame, tasks: int, task_bytes: int) -> dict[int, np.ndarray]:
    """Sums of the named vectors ``(k, task, v)``: over groups of tasks, as long as they are more than the driver takes
    (``DRIVER_BYTES``), then on the driver."""
    def add(table: pa.Table) -> pa.Table:
        v = np.zeros(0)
        for b in table.column("v"):
            x = np.frombuffer(b.as_buffer(), float)
            v = x.copy() if not len(v) else np.add(v, x, out=v)
        return pa.table({"k": table.column("k").slice(0, 1), "task": table.column("task").slice(0, 1), "v": pa.array([v.tobytes()], pa.binary())})

    while tasks > 1 and tasks * task_bytes > DRIVER_BYTES:
        rows = rows.withColumn("task", F.expr(f"task div {_TREE}").cast("int")).groupBy("k", "task").applyInArrow(lambda t: add(t), "k int, task int, v binary")
        tasks = -(-tasks // _TREE)
    out: dict[int, np.ndarray] = {}
    for batch in rows.select("k", "v").toArrow().to_batches():
        for k, v in zip(batch.column("k").to_pylist(), batch.column("v")):
            x = np.frombuffer(v.as_buffer(), float)
            out[k] = out[k] + x if k in out else x
    return out


def _summed(data: DataFrame, tasks: int, shape: tuple[int, int], work: Callable[[np.ndarray, pa.RecordBatch], None]) -> dict[int, np.ndarray]:
    """``work`` adds a batch to a task's array of this shape; its columns (one a model) are summed over the tasks."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, any_ = np.zeros(shape, order="F"), False
        for batch in batches:
            if batch.num_rows:
                work(total, batch)
                any_ = True
        if any_:
            k, task = total.shape[1], TaskContext.get().partitionId()
            vectors = pa.array([np.ascontiguousarray(total[:, i]).tobytes() for i in range(k)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, task, np.int32)), vectors], ["k", "task", "v"])

    return _tree_sums(data.mapInArrow(local, "k int, task int, v binary"), tasks, 8 * shape[0] * shape[1])


def _tasks(data: DataFrame) -> int:
    return data.rdd.getNumPartitions()  # planning only, no job


def _one_a_core(data: DataFrame) -> DataFrame:
    """``data`` in a task for each core at most: every task sends a vector a model, however few its rows."""
    return data.coalesce(data.sparkSession.sparkContext.defaultParallelism)


_COLUMNS = ("indices", "values", "ys", "fold")


def _curvatures(data: DataFrame, tasks: int, size: int) -> dict[int, np.ndarray]:
    """Per train fold, and in all (key 0): the number of rows, then the sum of the squares of each feature."""
    folds = [r["fold"] for r in data.where(F.col("fold") > 0).select("fold").distinct().collect()]

    def work(total: np.ndarray, batch: pa.RecordBatch) -> None:
        _, fold = _labels(batch)
        for rows, chunk in _chunks(batch):
            chunk.value = chunk.value**2
            chunk.add_left(total, (fold[rows][:, None] == np.array(folds)).astype(float))

    got = _summed(data.select(*_COLUMNS), tasks, (size + 1, len(folds)), work) if folds else {}
    out = {f: got[i] for i, f in enumerate(folds)}
    return out | {0: sum(out.values(), np.zeros(size + 1))}


# ---------------------------------------------------------------- L-BFGS for a grid of models

class _Search:
    """One model's recursion. ``trial`` is the point to be evaluated next; ``tell`` takes its loss and gradient. The
    recursion starts from the Hessian's diagonal at 0, a quarter of the features' squares and the ridge."""

    def __init__(self, model: Model, width: int, tol: float, squares: np.ndarray, passes: int):
        self.model, self.tol, self.passes_left = model, tol, passes
        self.ridge = np.full(width, 1.0 / model.C)
        self.ridge[0] = 0.0
        self.scale = 1.0 / np.maximum(0.25 * squares + self.ridge, 1e-300)
        self.trial, self.point = np.zeros(width), None
        self.value, self.gradient = np.inf, np.zeros(width)
        self.direction, self.slope, self.step = np.zeros(width), 0.0, 1.0
        self.pairs: list[tuple[np.ndarray, np.ndarray, float]] = []

    def _towards(self) -> np.ndarray:
        """Minus the inverse Hessian's estimate times the gradient (two-loop recursion)."""
        q, parts = self.gradient.copy(), []
        for s, y, rho in reversed(self.pairs):
            a = rho * (s @ q)
            q -= a * y
            parts.append(a)
        q *= self.scale
        if self.pairs:
            s, y, rho = self.pairs[-1]
            q *= 1.0 / (rho * (y @ (self.scale * y)))
        for (s, y, rho), a in zip(self.pairs, reversed(parts)):
            q += (a - rho * (y @ q)) * s
        return -q

    def tell(self, loss: float, gradient: np.ndarray | Callable[[], np.ndarray], rows: float) -> bool:
        """True while the search goes on. ``gradient`` is the loss's, or gives it: a step that is too long does not ask for it."""
        self.passes_left -= 1
        value = loss + 0.5 * float(self.ridge @ self.trial**2)
        if self.point is not None and not value <= self.value + 1e-4 * self.step * self.slope:
            if value - self.value <= 1e-14 * abs(self.value):  # equal within rounding
                return False
            drop = value - self.value - self.step * self.slope
            self.step *= min(max(-0.5 * self.slope * self.step / drop, 0.1), 0.5) if np.isfinite(drop) and drop > 0 else 0.1
            self.trial = self.point + self.step * self.direction
            return True
        gradient = (gradient() if callable(gradient) else gradient) + self.ridge * self.trial
        if self.point is not None:
            s, y = self.trial - self.point, gradient - self.gradient
            if (sy := float(s @ y)) > 1e-300:
                self.pairs = [*self.pairs[-(MEMORY - 1):], (s, y, 1.0 / sy)]
            self.model.steps += 1
        self.point, self.value, self.gradient = self.trial, value, gradient
        self.model.weights = self.point
        if np.abs(gradient).max() <= self.tol * max(rows, 1.0):
            return False
        self.direction = self._towards()
        self.slope = float(self.direction @ gradient)
        self.step = 1.0
        self.trial = self.point + self.step * self.direction
        return self.slope < 0


def _evaluate(given: Broadcast):
    """Adds a batch's loss, gradient and number of rows for each of the broadcast models (weights, categories, folds)."""
    def work(total: np.ndarray, batch: pa.RecordBatch) -> None:
        w, category, left_out = given.value
        y, fold = _labels(batch)
        for rows, chunk in _chunks(batch):
            t, f = y[rows][:, category], fold[rows][:, None]
            on = (f > 0) & (f != left_out)
            z = chunk.times(w)
            total[-2] += np.where(on, np.logaddexp(0.0, z) - t * z, 0.0).sum(0)
            total[-1] += on.sum(0)
            chunk.add_left(total[:-2], np.where(on, 0.5 * (1.0 + np.tanh(0.5 * z)) - t, 0.0))

    return work


def fit_sparse(data: DataFrame, size: int, models: Sequence[Model], max_steps: int = 10_000, tol: float = 1e-10) -> list[Model]:
    """K5: fit all ``models`` on the rows ``(indices, values, ys, fold)`` with fold > 0 and other than the one left out. A model
    is done when no entry of its gradient exceeds ``tol`` times its number of rows (or a step no longer lowers the
    objective). ``data`` is read once a step: give a written table. A model that is done makes room for the next one, so every pass
    but the last few works on as many models as ``PASS_BYTES`` lets it."""
    sc, models, data = data.sparkSession.sparkContext, list(models), _one_a_core(data)
    tasks = _tasks(data)
    squares = _curvatures(data, tasks, size)
    group, waiting, open_ = max(1, PASS_BYTES // (8 * (size + 3))), iter(models), []
    with ThreadPoolExecutor(_SEARCH_THREADS) as threads:
        while True:
            for m in islice(waiting, group - len(open_)):
                open_.append(_Search(m, size + 1, tol, squares[0] - (squares[m.fold] if m.fold in squares and m.fold else 0.0), max_steps))
                m.weights, m.steps = np.zeros(size + 1), 0
            open_ = [s for s in open_ if s.passes_left > 0]
            if not open_:
                break
            w = np.stack([s.trial for s in open_]).T  # a model's vector in one piece
            given = sc.broadcast((w, np.array([s.model.category for s in open_]), np.array([s.model.fold for s in open_])))
            got = _summed(data.select(*_COLUMNS), tasks, (size + 3, len(open_)), _evaluate(given))
            given.destroy()
            told = threads.map(lambda i: i in got and got[i][-1] > 0 and open_[i].tell(got[i][-2], got[i][:-2], got[i][-1]), range(len(open_)))
            open_ = [s for s, on in zip(open_, list(told)) if on]
    return models


# ---------------------------------------------------------------- models dealt to tasks

def _packed(data: DataFrame) -> DataFrame:
    """The train rows ``(indices, values, ys, fold)`` as blocks of rows of one fold, at most ``_WORK`` entries each where a
    row has no more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in np.unique(folds):
                part = batch.take(pa.array(np.flatnonzero(folds == f)))
                y, _ = _labels(part)
                for rows, c in _chunks(part):
                    parts = (c.lengths, c.index.astype(np.int32), c.value, y[rows])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(f)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["fold", "lengths", "index", "value", "ys"])

    return data.where("fold > 0").select(*_COLUMNS).mapInArrow(run, "fold int, lengths binary, index binary, value binary, ys binary")


class _Held:
    """The train rows that a task holds."""

    def __init__(self, blocks: Iterator):
        self.blocks: list[tuple[int, _Chunk, np.ndarray]] = []
        for fold, lengths, index, value, ys in blocks:
            at = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int64))])
            chunk = _Chunk(at, np.frombuffer(index, np.int32), np.frombuffer(value))
            self.blocks.append((fold, chunk, np.frombuffer(ys).reshape(chunk.n, -1)))

    def fit(self, model: Model, size: int, max_steps: int, tol: float) -> None:
        model.weights, model.steps = np.zeros(size + 1), 0
        train = [(chunk, y[:, model.category]) for fold, chunk, y in self.blocks if fold != model.fold]
        rows = sum(chunk.n for chunk, _ in train)
        if not rows or max_steps < 1:
            return
        squares = np.zeros(size + 1)
        squares[0] = rows
        for chunk, _ in train:
            squares[1:] += np.bincount(chunk.index, chunk.value**2, size)
        search, on = _Search(model, size + 1, tol, squares, max_steps), True
        while on and search.passes_left > 0:
            margins = [chunk.margins(search.trial) for chunk, _ in train]
            loss = sum(float((np.logaddexp(0.0, z) - t * z).sum()) for (_, t), z in zip(train, margins))

            def slopes(margins=margins) -> np.ndarray:
                out = np.zeros(size + 1)
                for (chunk, t), z in zip(train, margins):
                    chunk.add_products(out, 0.5 * (1.0 + np.tanh(0.5 * z)) - t)
                return out

            on = search.tell(loss, slopes, rows)

    def counts(self, model: Model) -> np.ndarray:
        """True positives, positives, true negatives and negatives of the fold left out."""
        out = np.zeros(4)
        for fold, chunk, y in self.blocks:
            if fold == model.fold:
                t, hit = y[:, model.category] == 1, chunk.margins(model.weights) > 0
                out += [(t & hit).sum(), t.sum(), (~t & ~hit).sum(), (~t).sum()]
        return out


def _held_whole(data: DataFrame, models: Sequence[Model]) -> RDD | None:
    """The train rows in one partition, for tasks that hold them; None where they are too large or the models too few."""
    if 2 * len(models) < data.sparkSession.sparkContext.defaultParallelism:
        return None
    entries, rows, labels = data.where("fold > 0").agg(F.sum(F.size("indices")), F.count(F.lit(1)), F.max(F.size("ys"))).first()
    if 12 * (entries or 0) + 8 * rows * ((labels or 0) + 4) > HELD_BYTES:  # and the starts, lengths and margins of rows
        return None
    return written(_packed(data), "packed").rdd.coalesce(1)


def fit_apart(rows: RDD, size: int, models: Sequence[Model], max_steps: int = 10_000, tol: float = 1e-10, weights: bool = True) -> dict[int, np.ndarray]:
    """K5-K7: fit each of ``models`` as ``fit_sparse`` does, in a task that holds the train rows, and count its hits on the fold it
    left out. The weights come to the driver only where they are asked for."""
    sc, models = rows.context, list(models)
    tasks = max(1, min(len(models), _TURNS * sc.defaultParallelism))

    def run(task: int, blocks: Iterator) -> Iterator[tuple[int, int, bytes, bytes]]:
        held = _Held(blocks)
        for k in range(task, len(models), tasks):
            m = Model(models[k].category, models[k].C, models[k].fold)
            held.fit(m, size, max_steps, tol)
            yield k, m.steps, held.counts(m).tobytes(), m.weights.tobytes() if weights else b""

    counts = {}
    for k, steps, count, w in sc.union([rows] * tasks).mapPartitionsWithIndex(run).collect():
        models[k].steps, models[k].weights, counts[k] = steps, np.frombuffer(w), np.frombuffer(count)
    return counts


def _predictions(given: Broadcast, batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray]]:
    for rows, chunk in _chunks(batch):
        yield rows, chunk.times(given.value[0])


def _shared_models(data: DataFrame, models: Sequence[Model]) -> Broadcast:
    return data.sparkSession.sparkContext.broadcast(
        (np.stack([m.weights for m in models]).T, np.array([m.category for m in models]), np.array([m.fold for m in models])))


def sparse_cv_grid(data: DataFrame, models: Sequence[Model], categories: Sequence[str]) -> DataFrame:
    """``(category, C, fold, n_valid, metric)`` as in ``train.cv_grid``, on sparse rows."""
    counts, tasks, group = {}, _tasks(data), max(1, PASS_BYTES // (8 * len(models[0].weights))) if models else 1
    for at in range(0, len(models), group):
        some = models[at:at + group]
        given = _shared_models(data, some)

        def count(total: np.ndarray, batch: pa.RecordBatch, given=given) -> None:
            _, category, left_out = given.value
            y, fold = _labels(batch)
            for rows_, z in _predictions(given, batch):
                t, on, hit = y[rows_][:, category] == 1, fold[rows_][:, None] == left_out, z > 0
                total += np.stack([(on & t & hit).sum(0), (on & t).sum(0), (on & ~t & ~hit).sum(0), (on & ~t).sum(0)])

        counts |= {at + i: v for i, v in _summed(data.select(*_COLUMNS), tasks, (4, len(some)), count).items()}
    return _grid_table(data.sparkSession, models, counts, categories)


def _grid_table(spark: SparkSession, models: Sequence[Model], counts: dict[int, np.ndarray], categories: Sequence[str]) -> DataFrame:
    rows = []
    for i, (tp, pos, tn, neg) in sorted(counts.items()):
        m = models[i]
        rows.append((categories[m.category], m.C, m.fold, int(pos + neg), float(((tp / pos if pos else 0.0) + (tn / neg if neg else 0.0)) / 2)))
    return spark.createDataFrame(rows, "category string, C double, fold int, n_valid long, metric double")


def sparse_cv(data: DataFrame, size: int, categories: Sequence[str], c_range: Sequence[float] = C_RANGE, weights: bool = True, **search) -> tuple[list[Model], DataFrame]:
    """The fitted grid (category x C x fold left out) and its ``sparse_cv_grid``. Without ``weights``, models that were
    dealt to tasks come back without theirs."""
    folds = sorted(r["fold"] for r in data.where(F.col("fold") > 0).select("fold").distinct().collect())
    models = [Model(k, float(c), int(f)) for k in range(len(categories)) for c in c_range for f in folds]
    if (held := _held_whole(data, models)) is not None:
        return models, _grid_table(data.sparkSession, models, fit_apart(held, size, models, weights=weights, **search), categories)
    return fit_sparse(data, size, models, **search), sparse_cv_grid(data, models, categories)


def sparse_final(data: DataFrame, size: int, grid: DataFrame, categories: Sequence[str], **search) -> list[Model]:
    """Per category the model of its best C, fitted on all train folds."""
    best = {r["category"]: r["C"] for r in best_c(grid).where("is_best = 1").collect()}
    models = [Model(k, best[c], 0) for k, c in enumerate(categories)]
    if (held := _held_whole(data, models)) is None:
        return fit_sparse(data, size, models, **search)
    fit_apart(held, size, models, **search)
    return models


def sparse_scores(data: DataFrame, models: Sequence[Model], categories: Sequence[str]) -> DataFrame:
    """``(id, category, fold, y_true, y_score)`` of the rows of each model's left-out fold (0: the test split)."""
    given, names = _shared_models(data, models), np.array(list(categories), object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, category, left_out = given.value
        for batch in batches:
            if not batch.num_rows:
                continue
            y, fold = _labels(batch)
            for rows, z in _predictions(given, batch):
                i, k = np.nonzero(fold[rows][:, None] == left_out)
                at = i + rows.start
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)), pa.array(names[category[k]], pa.string()), pa.array(fold[at], pa.int32()),
                     pa.array(y[at, category[k]].astype(np.int32)), pa.array(0.5 * (1.0 + np.tanh(0.5 * z[i, k])))], ["id", "category", "fold", "y_true", "y_score"])

    id_type = data.schema["id"].dataType.simpleString()
    return data.select("id", "indices", "values", "ys", "fold").mapInArrow(run, f"id {id_type}, category string, fold int, y_true int, y_score double")
