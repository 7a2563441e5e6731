"""Small gradient-boosted trees (logistic loss) over a bounded training sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: split feature and threshold per inner node, value per leaf."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of ``x``."""
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaves.shape[1])) if len(self.leaves) else 0
        rows = np.arange(len(x))
        for f, t, v in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (len(v) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Boost ``rounds`` trees of second-order gain over histograms of quantile bins."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    trees = Trees(float(np.log(p / (1 - p))), np.empty((0, 1), np.int64), np.empty((0, 1)), np.empty((0, 2)))
    if not len(y) or y.min() == y.max():
        return trees
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    score = np.full(len(y), trees.base)
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-score))
        grad, hess = y - prob, prob * (1 - prob)
        f, t = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = node == k
                if rows.sum() < 2:
                    continue
                g, h = grad[rows], hess[rows]
                best = 1e-9
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    left_g = np.cumsum(np.bincount(binned[rows, j], g, len(c) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[rows, j], h, len(c) + 1))[:-1]
                    gain = left_g**2 / (left_h + ridge) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + ridge) - g.sum() ** 2 / (h.sum() + ridge)
                    if gain.max() > best:
                        best, f[k], t[k] = gain.max(), j, c[gain.argmax()]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        leaf = node - (2**depth - 1)
        value = np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + ridge) * rate
        score += value[leaf]
        features.append(f)
        thresholds.append(t)
        leaves.append(value)
    return Trees(trees.base, np.array(features), np.array(thresholds), np.array(leaves))
