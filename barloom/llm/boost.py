"""Gradient-boosted trees for a binary outcome, in numpy: quantile bins, second-order gains, small trees."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0
    depth: int = 3

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for column, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), column[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, bins: int = 32) -> Boosted:
    """Full binary trees of the given depth; a node that gains nothing by a split sends all rows left."""
    n, m = x.shape
    rate0 = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    model = Boosted(start=float(np.log(rate0 / (1 - rate0))), depth=depth)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)  # bin b: x <= cuts[b]
    width = bins + 1
    score = np.full(n, model.start)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        column, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            best = np.zeros(count)
            for k in range(m):
                if not len(cuts[k]):
                    continue
                key = at * width + binned[:, k]
                gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(axis=1)
                hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(axis=1)
                gain = gs**2 / (hs + ridge) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                gain = gain[:, : len(cuts[k])]
                b = gain.argmax(axis=1)
                top = gain[np.arange(count), b]
                better = np.flatnonzero(top > best + 1e-9)
                best[better] = top[better]
                column[first + better] = k
                cut[first + better] = cuts[k][b[better]]
            node = 2 * node + 1 + (x[np.arange(n), column[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        model.trees.append((column, cut, value))
        score += value[leaf]
    return model
