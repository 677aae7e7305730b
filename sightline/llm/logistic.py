"""A small logistic regression for bounded tables of features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Logistic:
    """Standardised features, an L2 penalty, Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        self.w = np.zeros(z.shape[1])
        self.w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        reg = np.full(z.shape[1], penalty)
        reg[-1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(reg), z.T @ (p - y) + reg * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (np.clip(x, self.mean - 20 * self.scale, self.mean + 20 * self.scale) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.w[:-1] + self.w[-1], -30, 30)))

    def column(self, names: list[str]) -> Column:
        """The same as an expression over columns."""
        z = F.lit(float(self.w[-1]))
        for c, m, s, w in zip(names, self.mean.tolist(), self.scale.tolist(), self.w[:-1].tolist(), strict=True):
            x = F.least(F.greatest(F.col(c), F.lit(m - 20 * s)), F.lit(m + 20 * s))
            z = z + (x - m) / s * w
        return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
