"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth; node k of a tree has the children 2k + 1 and 2k + 2."""

    def __init__(self, edges: np.ndarray, feature: np.ndarray, at: np.ndarray, value: np.ndarray, base: float):
        self.edges, self.feature, self.at, self.value, self.base = edges, feature, at, value, base

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.3, bins: int = 16, ridge: float = 1.0) -> Boosted:
        n, m = x.shape
        edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T.astype(np.float32)
        binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(m)], axis=1)
        place = binned + np.arange(m) * bins
        p = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        base = float(np.log(p / (1 - p)))
        out = np.full(n, base)
        inner, leaves = (1 << depth) - 1, 1 << depth
        features, ats, values = (np.zeros((trees, k), t) for k, t in ((inner, np.int32), (inner, np.int32), (leaves, np.float32)))
        for t in range(trees):
            p = 1 / (1 + np.exp(-out))
            g, h = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                wide = 1 << level
                key = (node[:, None] * (m * bins) + place).ravel()
                gs, hs = (np.bincount(key, np.repeat(v, m), wide * m * bins).reshape(wide, m, bins).cumsum(2) for v in (g, h))
                total_g, total_h = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
                best = gain[:, :, :-1].reshape(wide, -1).argmax(1)
                f, at = best // (bins - 1), best % (bins - 1)
                features[t, wide - 1 : 2 * wide - 1], ats[t, wide - 1 : 2 * wide - 1] = f, at
                node = 2 * node + (binned[np.arange(n), f[node]] > at[node])
            values[t] = rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + ridge)
            out += values[t][node]
        return cls(edges, features, ats, values, base)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, at, value in zip(self.feature, self.at, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(len(value).bit_length() - 1):
                f = feature[node]
                node = 2 * node + 1 + (x[rows, f] > self.edges[f, at[node]])
            out += value[node - len(feature)]
        return out
