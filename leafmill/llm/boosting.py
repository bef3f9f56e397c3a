"""Small learners for the bounded samples that the classifiers are fitted on; executors only apply them."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Gradient-boosted trees of fixed depth for 0/1 labels: logistic loss, Newton leaves, histogram splits."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, smooth: float = 5.0):
        self.trees, self.depth, self.rate, self.bins, self.smooth = trees, depth, rate, bins, smooth

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        b, width = self._binned(x), self.bins + 1
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, inner = float(np.log(p / (1 - p))), (1 << self.depth) - 1
        f = np.full(len(y), self.start)
        self.feature, self.cut, self.leaf = (np.zeros((self.trees, n), t) for n, t in ((inner, np.int64), (inner, np.int64), (inner + 1, np.float64)))
        for t in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                base, n = (1 << level) - 1, 1 << level
                best, choice = np.full(n, 1e-9), np.zeros((n, 2), np.int64)
                choice[:, 1] = width  # no split: all go left
                for j in range(x.shape[1]):
                    slot = (node - base) * width + b[:, j]
                    gs, hs = (np.bincount(slot, w, n * width).reshape(n, width).cumsum(axis=1) for w in (g, h))
                    gr, hr = gs[:, -1:] - gs, hs[:, -1:] - hs
                    gain = gs**2 / (hs + self.smooth) + gr**2 / (hr + self.smooth) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.smooth)
                    k = gain.argmax(axis=1)
                    won = gain[np.arange(n), k] > best
                    best[won] = gain[np.arange(n), k][won]
                    choice[won] = np.stack([np.full(n, j), k], axis=1)[won]
                self.feature[t, base : base + n], self.cut[t, base : base + n] = choice.T
                node = 2 * node + 1 + (b[np.arange(len(y)), self.feature[t, node]] > self.cut[t, node])
            node -= inner
            gs, hs = (np.bincount(node, w, inner + 1) for w in (g, h))
            self.leaf[t] = self.rate * gs / (hs + self.smooth)
            f += self.leaf[t, node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows, inner = self._binned(x), np.arange(len(x)), (1 << self.depth) - 1
        f = np.full(len(x), self.start)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, self.feature[t, node]] > self.cut[t, node])
            f += self.leaf[t, node - inner]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and values of a non-decreasing fit of y on x, to be interpolated between."""
    at, back = np.unique(x, return_inverse=True)
    weight = np.bincount(back).astype(float)
    value = np.bincount(back, y) / weight
    blocks: list[list[float]] = []  # value, weight, weighted place
    for v, w, p in zip(value, weight, at):
        blocks.append([v, w, p * w])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.array([b[2] / b[1] for b in blocks]), np.clip([b[0] for b in blocks], 0, 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression without intercept, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w
