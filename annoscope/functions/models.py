"""An example user model for batch scoring (K12): a seeded linear model over vectors.

Kept in its own small module so Python workers unpickling the scorer import only this file.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

from annoscope.schema import CATEGORIES

DIM = 64


def weight(c: str, j: int) -> float:
    """Weights of the example model: 2·u01(category ‖ j) − 1 (u01 = first 8 hex digits of md5 / 2³²)."""
    h = hashlib.md5(f"{c}{j}".encode()).hexdigest()[:8]
    return 2.0 * (int(h, 16) / 4294967296.0) - 1.0


class LinearModel:
    """P(category | x) = sigmoid(w_c · x); stands in for a neural scorer."""

    def __init__(self, categories=CATEGORIES, dim: int = DIM):
        self.categories = tuple(categories)
        self.w = np.array([[weight(c, j) for j in range(dim)] for c in self.categories])

    def predict(self, xs: pd.Series) -> pd.DataFrame:
        x = np.stack([np.asarray(v, dtype=np.float64) for v in xs]) if len(xs) else np.zeros((0, self.w.shape[1]))
        p = 1.0 / (1.0 + np.exp(-(x @ self.w.T)))
        return pd.DataFrame(p, columns=[f"{c}_score" for c in self.categories])


def load_linear_model() -> LinearModel:
    return LinearModel()


def predict_linear(model: LinearModel, xs: pd.Series) -> pd.DataFrame:
    return model.predict(xs)
