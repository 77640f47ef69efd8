"""Small logistic models fitted in numpy on a bounded sample that lies on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Inputs:
    """Rows of inputs that are 0 or 1, by the cells that are 1, next to some dense columns."""

    row: np.ndarray
    column: np.ndarray
    width: int
    dense: np.ndarray

    def __len__(self) -> int:
        return len(self.dense)

    def times(self, weights: np.ndarray) -> np.ndarray:
        """The rows times ``weights``, of which the last is the intercept."""
        out = np.bincount(self.row, weights[self.column], minlength=len(self))
        return out + self.dense @ weights[self.width : -1] + weights[-1]

    def back(self, values: np.ndarray) -> np.ndarray:
        """The transposed product, the intercept's column of ones last."""
        sparse = np.bincount(self.column, values[self.row], minlength=self.width)
        return np.concatenate([sparse, self.dense.T @ values, [values.sum()]])

    def take(self, mask: np.ndarray) -> Inputs:
        number = np.cumsum(mask) - 1
        held = mask[self.row]
        return Inputs(number[self.row[held]], self.column[held], self.width, self.dense[mask])

    def beside(self, column: np.ndarray) -> Inputs:
        return Inputs(self.row, self.column, self.width, np.hstack([self.dense, column[:, None]]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: Inputs, y: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights with the intercept last; accelerated gradient steps on the penalised log-loss.

    Without rows, or with rows of one class, the intercept alone is set.
    """
    weights = np.zeros(x.width + x.dense.shape[1] + 1)
    if len(y) == 0 or y.mean() in (0.0, 1.0):
        weights[-1] = 40.0 if len(y) and y[0] else -40.0
        return weights
    rate = y.mean()
    weights[-1] = np.log(rate / (1 - rate))
    # the largest eigenvalue of the Gram matrix bounds the curvature
    v = np.ones(len(weights))
    for _ in range(15):
        v = x.back(x.times(v))
        v /= np.linalg.norm(v)
    size = 1 / (0.3 * np.linalg.norm(x.back(x.times(v))) / len(y) + penalty)
    ahead, before = weights.copy(), weights.copy()
    for step in range(1, steps + 1):
        gradient = x.back(sigmoid(x.times(ahead)) - y) / len(y)
        gradient[:-1] += penalty * ahead[:-1]
        weights = ahead - size * gradient
        ahead = weights + (step - 1) / (step + 2) * (weights - before)
        before = weights
    return weights


def predict(x: Inputs, weights: np.ndarray) -> np.ndarray:
    return sigmoid(x.times(weights))
