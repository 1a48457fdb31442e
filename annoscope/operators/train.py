"""Model training and batch scoring.

L2 logistic regression in sklearn's parametrisation: ½‖w‖² + C·Σ loss, intercept unpenalised. The grid over categories
(one-vs-all), C and predefined folds is fitted by Newton steps of *all* its models at once: one pass over the
feature table per step sums each model's gradient and Hessian per task and then over tasks, so the grid costs a
few dozen passes instead of a job per model and line search. What reaches the driver is the sums, (dimensions + 1)² numbers
per model; models are taken in groups so that one pass sends at most ``PASS_BYTES``. Validation
metrics, out-of-fold and test scores come from the fitted grid in one more pass each.

``fit_logreg`` fits a single model with Spark ML (same optimum; ``regParam = 1 / (C · n)``), for persistence
as a Spark ML model. Batch scoring with a user model is ``mapInPandas`` (Arrow batches, model loaded once per worker).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The reference's C grid (descending, so ties pick the largest C).
C_RANGE: tuple[float, ...] = (1e7, 1e6, 1e5, 1e4, 1e3, 1e2, 1e1, 1e0, 1e-1, 1e-2, 1e-3, 1e-4, 1e-5, 1e-6, 1e-7)
PASS_BYTES = 64 << 20


def prepare(features: DataFrame, vec: str = "vec", label: str = "y") -> DataFrame:
    """K4: ``features`` Vector column + ``label`` double; ``fold`` > 0 is train, 0 is test."""
    from pyspark.ml.functions import array_to_vector

    return features.select("*", array_to_vector(F.col(vec).cast("array<double>")).alias("features"),
                           F.col(label).cast("double").alias("label"))


def fit_logreg(train: DataFrame, C: float, n_fit: int | None = None, max_iter: int = 10000, tol: float = 1e-10):
    """K5: one sklearn-equivalent L2 logistic regression (lbfgs) for inverse strength ``C``, as a Spark ML model."""
    from pyspark.ml.classification import LogisticRegression

    n = n_fit if n_fit is not None else train.count()
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (C * n), elasticNetParam=0.0,
                            standardization=False, fitIntercept=True, maxIter=max_iter, tol=tol)
    return lr.fit(train)


def positive_score(model, df: DataFrame, out: str = "y_score") -> DataFrame:
    """P(class 1) as a double column."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


# ---------------------------------------------------------------- all models of a grid at once

@dataclass
class Model:
    """One model of the grid: the category's position in ``ys``, C, and the validation fold left out (0: none)."""

    category: int
    C: float
    fold: int
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # intercept first
    steps: int = 0


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features with a leading 1, labels of all categories, folds) of a batch (vec, ys, fold)."""
    n = batch.num_rows
    x = np.asarray(batch.column("vec").flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1)
    y = np.asarray(batch.column("ys").flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1)
    return np.concatenate([np.ones((n, 1)), x], axis=1), y, batch.column("fold").to_numpy(zero_copy_only=False)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _totals(data: DataFrame, work, columns: Sequence[str] = ("vec", "ys", "fold")) -> dict[int, np.ndarray]:
    """``work`` maps a batch to named vectors; their sums over all batches and tasks."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for k, v in work(*_matrix(batch)).items():
                    total[k] = total[k] + v if k in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["k", "v"])

    def add(table):
        v = np.sum([np.frombuffer(b, float) for b in table.column("v").to_pylist()], axis=0)
        return pa.table({"k": pa.array(table.column("k").to_pylist()[:1], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

    rows = data.select(*columns).mapInArrow(local, "k int, v binary").groupBy("k").applyInArrow(lambda t: add(t), "k int, v binary")
    return {r["k"]: np.frombuffer(bytes(r["v"]), float) for r in rows.collect()}


def fit_models(data: DataFrame, models: Sequence[Model], max_steps: int = 60, tol: float = 1e-9) -> list[Model]:
    """Fit all ``models`` on rows (vec, ys, fold) with fold > 0 and other than the one left out."""
    first = data.select(F.size("vec").alias("d")).first()
    if first is None:
        raise ValueError("no rows to fit on")
    width = first["d"] + 1
    group = max(1, PASS_BYTES // (8 * (width + 1) * (width + 1)))
    models = list(models)
    for at in range(0, len(models), group):
        _newton(data, models[at:at + group], width, max_steps, tol)
    return models


def _newton(data: DataFrame, models: list[Model], width: int, max_steps: int, tol: float) -> None:
    """Damped Newton steps; a step that does not lower a model's objective is halved."""
    for m in models:
        m.weights, m.steps = np.zeros(width), 0
    best = {i: (np.inf, m.weights, np.zeros(width)) for i, m in enumerate(models)}  # objective, weights, last step
    open_ = list(range(len(models)))
    for _ in range(max_steps):
        now = [(i, models[i].category, models[i].fold, models[i].weights) for i in open_]

        def sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray, now=now) -> dict[int, np.ndarray]:
            out = {}
            for i, c, f, w in now:
                on = (fold > 0) & (fold != f)
                xs, t = x[on], y[on, c]
                z = xs @ w
                p = _sigmoid(z)
                loss = np.logaddexp(0.0, z).sum() - t @ z
                out[i] = np.concatenate([[loss], xs.T @ (p - t), ((xs * (p * (1 - p))[:, None]).T @ xs).reshape(-1)])
            return out

        got, going = _totals(data, sums), []
        for i in open_:
            m, s = models[i], got.get(i)
            if s is None:  # no row to fit on: the weights stay 0
                continue
            ridge = np.full(width, 1.0 / m.C)
            ridge[0] = 0.0
            objective = s[0] + 0.5 * float(ridge @ m.weights**2)
            old, base, step = best[i]
            if objective > old + 1e-12 * abs(old):
                step = step / 2
                if np.abs(step).max() > 1e-12:
                    best[i], m.weights = (old, base, step), base + step
                    going.append(i)
                else:
                    m.weights = base
                continue
            gradient = s[1:1 + width] + ridge * m.weights
            hessian = s[1 + width:].reshape(width, width) + np.diag(ridge + 1e-12)
            step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            m.steps += 1
            if -(gradient @ step) <= tol * (1 + abs(objective)):
                continue
            best[i], m.weights = (objective, m.weights, step), m.weights + step
            going.append(i)
        open_ = going
        if not open_:
            return


def cv_models(data: DataFrame, categories: Sequence[str], c_range: Sequence[float] = C_RANGE) -> list[Model]:
    """The fitted grid: a model for each category, C and fold left out."""
    folds = sorted(r["fold"] for r in data.where(F.col("fold") > 0).select("fold").distinct().collect())
    return fit_models(data, [Model(k, float(c), int(f)) for k in range(len(categories)) for c in c_range for f in folds])


def cv_grid(data: DataFrame, models: Sequence[Model], categories: Sequence[str]) -> DataFrame:
    """``(category, C, fold, n_valid, metric)``: ROC AUC of the hard predictions (= balanced accuracy)
    of each model on the fold it left out."""
    chosen = [(i, m.category, m.fold, m.weights) for i, m in enumerate(models)]

    def counts(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        for i, c, f, w in chosen:
            on = fold == f
            t, p = y[on, c] == 1, x[on] @ w > 0
            out[i] = np.array([(t & p).sum(), t.sum(), (~t & ~p).sum(), (~t).sum()], float)
        return out

    rows = []
    for i, (tp, pos, tn, neg) in sorted(_totals(data, counts).items()):
        m = models[i]
        rows.append((categories[m.category], m.C, m.fold, int(pos + neg), float(((tp / pos if pos else 0.0) + (tn / neg if neg else 0.0)) / 2)))
    return data.sparkSession.createDataFrame(rows, "category string, C double, fold int, n_valid long, metric double")


def best_c(grid: DataFrame) -> DataFrame:
    """K8/I4: per category the fold-size-weighted mean metric of each C, and the best C (ties -> largest C)."""
    per_c = grid.groupBy("category", "C").agg((F.sum(F.col("metric") * F.col("n_valid")) / F.sum("n_valid")).alias("mean_metric"))
    best = per_c.groupBy("category").agg(F.max(F.struct("mean_metric", "C"))["C"].alias("best_C"))
    return per_c.join(best, "category").withColumn("is_best", (F.col("C") == F.col("best_C")).cast("int")).drop("best_C")


def score_models(data: DataFrame, models: Sequence[Model], categories: Sequence[str]) -> DataFrame:
    """``(id, category, fold, y_true, y_score)`` of the rows of each model's left-out fold (fold 0, the
    test split, for a model that left none out)."""
    chosen = [(m.category, m.fold, m.weights) for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, fold = _matrix(batch)
            for c, f, w in chosen:
                on = np.flatnonzero(fold == f)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(on)), pa.array([categories[c]] * len(on), pa.string()),
                                                  pa.array(fold[on], pa.int32()), pa.array(y[on, c].astype(int), pa.int32()),
                                                  pa.array(_sigmoid(x[on] @ w), pa.float64())], ["id", "category", "fold", "y_true", "y_score"])

    return data.select("id", "vec", "ys", "fold").mapInArrow(run, "id long, category string, fold int, y_true int, y_score double")


def out_of_fold(data: DataFrame, models: Sequence[Model], grid: DataFrame, categories: Sequence[str]) -> DataFrame:
    """K9: per category and fold, the model of that fold's best C scores the fold (it was fitted on the others);
    prediction = score >= the fold's median score. ``(id, category, fold, y_true, y_score, y_pred)``."""
    from annoscope.operators.curves import median_predictions

    best = {(r["category"], r["fold"]): r["best"]["C"] for r in
            grid.groupBy("category", "fold").agg(F.max(F.struct("metric", "C")).alias("best")).collect()}
    chosen = [m for m in models if best[(categories[m.category], m.fold)] == m.C]
    return median_predictions(score_models(data, chosen, categories), ["category", "fold"])


def final_models(data: DataFrame, grid: DataFrame, categories: Sequence[str]) -> list[Model]:
    """Per category the model of its best C, fitted on all train folds."""
    best = {r["category"]: r["C"] for r in best_c(grid).where("is_best = 1").collect()}
    return fit_models(data, [Model(k, best[c], 0) for k, c in enumerate(categories)])


def batch_score(df: DataFrame, input_col: str, load: Callable[[], object], predict: Callable[[object, pd.Series], pd.DataFrame],
                out_schema: str, key_cols: Sequence[str] = ("id",)) -> DataFrame:
    """Score a table with a user model in Arrow batches (``mapInPandas``).

    ``load()`` builds the model once per Python worker process; ``predict(model, inputs)`` returns a
    DataFrame of score columns for a batch. ``out_schema`` lists the key and score columns."""
    keys = list(key_cols)
    cache: dict[str, object] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if "m" not in cache:
            cache["m"] = load()
        model = cache["m"]
        for b in batches:
            scores = predict(model, b[input_col])
            yield pd.concat([b[keys].reset_index(drop=True), scores.reset_index(drop=True)], axis=1)

    return df.select(*keys, input_col).mapInPandas(run, out_schema)
