"""Gradient-boosted trees for binary targets, on binned features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of a fixed depth, grown on the log loss with second-order gains, each on a share of the rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 16, ridge: float = 2.0, share: float = 0.35, seed: int = 3):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)])
        n, f = x.shape
        inner = (1 << depth) - 1
        self.depth = depth
        self.feature = np.zeros((trees, inner), np.int32)
        self.cut = np.full((trees, inner), np.inf)
        self.value = np.zeros((trees, 1 << depth))
        true = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(true / (1 - true)))
        score, rng, every = np.full(n, self.base), np.random.default_rng(seed), (x, binned, y, weight)
        for t in range(trees):
            rows = np.flatnonzero(rng.random(n) < share)
            x, binned, y, weight = (v[rows] for v in every)
            p = 1 / (1 + np.exp(-score[rows]))
            g, h = weight * (p - y), weight * p * (1 - p)
            node = np.zeros(len(rows), np.int64)
            for level in range(depth):
                width, first = 1 << level, (1 << level) - 1
                best = np.zeros(width)
                sums = [np.bincount(node, v, width) for v in (g, h)]
                for j in range(f):
                    k = len(self.cuts[j]) + 1
                    if k == 1:
                        continue
                    at = node * k + binned[:, j]
                    left = [np.cumsum(np.bincount(at, v, width * k).reshape(width, k), axis=1)[:, :-1] for v in (g, h)]
                    right = [s[:, None] - x_ for s, x_ in zip(sums, left, strict=True)]
                    gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - (sums[0] ** 2 / (sums[1] + ridge))[:, None]
                    gain[(left[1] < 0.5) | (right[1] < 0.5)] = 0
                    at_best = gain.argmax(axis=1)
                    better = gain[np.arange(width), at_best] > best + 1e-9
                    best[better] = gain[np.arange(width), at_best][better]
                    own = first + np.flatnonzero(better)
                    self.feature[t, own] = j
                    self.cut[t, own] = self.cuts[j][at_best[better]]
                node = 2 * node + (x[np.arange(len(rows)), self.feature[t, first + node]] > self.cut[t, first + node])
            sums = [np.bincount(node, v, 1 << depth) for v in (g, h)]
            self.value[t] = -rate * sums[0] / (sums[1] + ridge)
            score += self.value[t][self._leaves(every[0], t)]

    def _leaves(self, x: np.ndarray, t: int) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for level in range(self.depth):
            at = (1 << level) - 1 + node
            node = 2 * node + (x[rows, self.feature[t, at]] > self.cut[t, at])
        return node

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row."""
        out = np.full(len(x), self.base)
        for t in range(len(self.value)):
            out += self.value[t][self._leaves(x, t)]
        return out
