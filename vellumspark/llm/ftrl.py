"""Follow-the-regularised-leader (proximal) for sparse linear classifiers, with elastic-net penalties."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Ftrl:
    """One weight per (feature, output); the last feature row is the bias, which is not penalised.

    outputs == 1: logistic loss, labels 0 and 1.  outputs > 1: softmax loss, labels 0 to outputs - 1.
    """

    def __init__(self, features: int, outputs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features + 1, outputs))
        self.n = np.zeros((features + 1, outputs))

    def _solve(self, z: np.ndarray, root: np.ndarray, l1: float, l2: float) -> np.ndarray:
        """Weights; root: square roots of the summed squared gradients."""
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + root) / self.alpha + l2))

    def weights(self) -> np.ndarray:
        w = self._solve(self.z, np.sqrt(self.n), self.l1, self.l2)
        w[-1] = self._solve(self.z[-1], np.sqrt(self.n[-1]), 0.0, 0.0)
        return w

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        z, n, bare_z, bare_n = self.z[index], self.n[index], self.z[-1], self.n[-1]
        root, bare_root = np.sqrt(n), np.sqrt(bare_n)
        w, bare = self._solve(z, root, self.l1, self.l2), self._solve(bare_z, bare_root, 0.0, 0.0)
        error = probabilities((value @ w + bare)[None])[0]
        if len(error) == 1:
            error = error - label
        else:
            error[label] -= 1.0
        g = value[:, None] * error
        n += g * g
        self.z[index] = z + g - (np.sqrt(n) - root) / self.alpha * w
        self.n[index] = n
        more = bare_n + error * error
        self.z[-1] = bare_z + error - (np.sqrt(more) - bare_root) / self.alpha * bare
        self.n[-1] = more

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, seed: int = 7) -> np.ndarray:
        turn = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in turn.permutation(len(rows)):
                self.learn(*rows[i])
        return self.weights()


def list_values(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column without nulls as arrays."""
    ends = np.cumsum(pc.list_value_length(column).to_numpy())
    return np.split(column.flatten().to_numpy(), ends[:-1]) if len(column) else []


def probabilities(logits: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    """Rows of logits to probabilities: a sigmoid where there is one column, else a softmax."""
    logits = logits / temperature
    if logits.shape[1] == 1:
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -500, 500)))
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature in [0.05, 20] of least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = probabilities(logits, float(np.exp(log_t)))
        at = p[np.arange(len(labels)), labels] if p.shape[1] > 1 else np.where(labels == 1, p[:, 0], 1 - p[:, 0])
        return float(-np.log(np.maximum(at, 1e-15)).mean())

    a, b, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))
