"""Gradient-boosted trees for a binary target, on arrays of small size."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Depth-limited trees fitted to log loss by Newton steps over histograms of binned features."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, l2: float = 1.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.l2, self.least = trees, depth, rate, l2, least
        self.edges: list[np.ndarray] = []
        self.feature = self.cut = self.value = None
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        self.edges = [np.unique(np.concatenate([e, [(np.unique(c)[0] + np.unique(c)[-1]) / 2]])) for e, c in zip(self.edges, x.T, strict=True)]
        b, n, m = self._binned(x), len(x), x.shape[1]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(n, self.base)
        inner, leaves, wide = (1 << self.depth) - 1, 1 << self.depth, BINS + 1
        self.feature, self.cut = np.zeros((self.trees, inner), np.int64), np.full((self.trees, inner), np.inf)
        self.value = np.zeros((self.trees, leaves))
        for t in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            g, h = q - y, q * (1 - q)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                width = 1 << level
                size = width * wide
                gain = np.full((m, width, wide), -np.inf)
                for k in range(m):
                    cell = node * wide + b[:, k]
                    gs = np.bincount(cell, g, size).reshape(width, wide).cumsum(1)
                    hs = np.bincount(cell, h, size).reshape(width, wide).cumsum(1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    split = gs**2 / (hs + self.l2) + (ga - gs) ** 2 / (ha - hs + self.l2) - ga**2 / (ha + self.l2)
                    gain[k] = np.where((hs >= self.least) & (ha - hs >= self.least), split, -np.inf)
                flat = gain.transpose(1, 0, 2).reshape(width, -1)
                best = flat.argmax(1)
                for w in range(width):
                    if flat[w, best[w]] > 1e-6:
                        k, c = divmod(int(best[w]), wide)
                        if c < len(self.edges[k]):
                            self.feature[t, width - 1 + w], self.cut[t, width - 1 + w] = k, self.edges[k][c]
                node = 2 * node + (x[np.arange(n), self.feature[t, width - 1 + node]] >= self.cut[t, width - 1 + node])
            gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            self.value[t] = -self.rate * gs / (hs + self.l2)
            score += self.value[t][node]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, at = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                k = (1 << level) - 1 + node
                node = 2 * node + (x[at, self.feature[t, k]] >= self.cut[t, k])
            out += self.value[t][node]
        return out
