"""Follow-the-regularised-leader logistic regression on sparse rows.

Per-coordinate rates and elastic-net penalties: l1 leaves most weights at exactly zero,
l2 shrinks the rest. With two classes one weight vector is learned; with more, one per
class under a softmax. Rows are visited in a fixed order, so a fit is reproducible.
"""

from __future__ import annotations

import math

import numpy as np


class FTRL:
    def __init__(self, n_features: int, n_classes: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.k = 1 if n_classes == 2 else n_classes
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((n_features, self.k))
        self.n = np.zeros((n_features, self.k))
        self.bz, self.bn = np.zeros(self.k), np.zeros(self.k)

    def _solve(self, z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """(features x classes, bias); the bias carries no l1."""
        return self._solve(self.z, self.n, self.l1), self._solve(self.bz, self.bn, 0.0)

    def learn(self, idx: np.ndarray, val: np.ndarray, label: int, weight: float = 1.0) -> None:
        val = np.asarray(val, dtype=float)
        z, n = self.z[idx], self.n[idx]
        w = self._solve(z, n, self.l1)
        b = self._solve(self.bz, self.bn, 0.0)
        score = (w * val[:, None]).sum(axis=0) + b
        if self.k == 1:
            p = np.array([1 / (1 + math.exp(-max(-35.0, min(35.0, float(score[0])))))])
            error = p - label
        else:
            e = np.exp(score - score.max())
            error = e / e.sum()
            error[label] -= 1
        error = error * weight
        for g, zz, nn, ww, at in ((val[:, None] * error[None, :], z, n, w, idx), (error, self.bz, self.bn, b, None)):
            sigma = (np.sqrt(nn + g * g) - np.sqrt(nn)) / self.alpha
            if at is None:
                self.bz, self.bn = zz + g - sigma * ww, nn + g * g
            else:
                self.z[at], self.n[at] = zz + g - sigma * ww, nn + g * g

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int, weights: list[float] | None = None) -> FTRL:
        order = np.random.default_rng(0)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                if len(rows[i][0]):
                    self.learn(*rows[i], labels[i], 1.0 if weights is None else weights[i])
        return self


def temperature(scores: np.ndarray, labels: np.ndarray, low: float = 0.05, high: float = 20.0) -> float:
    """The divisor of the scores with the least log loss (golden section on its logarithm)."""
    if not len(scores):
        return 1.0

    def loss(log_t: float) -> float:
        s = scores / math.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())

    a, b, g = math.log(low), math.log(high), (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = loss(c), loss(d)
    for _ in range(60):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = loss(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = loss(d)
    return math.exp((a + b) / 2)
