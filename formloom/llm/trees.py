"""Histogram gradient-boosted trees for a binary label, in numpy.

Trees grow level by level on binned features. Once fitted they are flattened
into complete-tree arrays, which score all rows of a batch together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    """Complete trees: node i has children 2i+1 and 2i+2; rows with a value up to the threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**depth - 1)]
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 2.0, least: float = 10.0) -> FlatTrees:
    """Fit by Newton steps on the logistic loss; without rows or with one class the base rate is the score of all."""
    rows, features = x.shape
    rate_1 = (np.dot(weight, y) + 0.5) / (weight.sum() + 1.0)
    base = float(np.log(rate_1 / (1 - rate_1)))
    inner, leaves = 2**depth - 1, 2**depth
    out_f, out_t, out_l = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if not rows:
        return FlatTrees(out_f, out_t, out_l, base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(features) * bins
    margin = np.full(rows, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            width = 2**level
            cell = ((node[:, None] * features * bins) + flat).ravel()
            g, h, n = (np.bincount(cell, weights=np.repeat(v, features), minlength=width * features * bins).reshape(width, features, bins) for v in (grad, hess, np.ones(rows)))
            gl, hl, nl = (np.cumsum(v, axis=2)[:, :, :-1] for v in (g, h, n))
            gt, ht, nt = (v.sum(axis=2, keepdims=True) for v in (g, h, n))
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            gain[(nl < least) | (nt - nl < least)] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            chosen, cut = best // (bins - 1), best % (bins - 1)
            good = (gain.reshape(width, -1)[np.arange(width), best] > 1e-6) & np.array([cut[i] < len(edges[chosen[i]]) for i in range(width)])
            first = width - 1
            for i in np.flatnonzero(good):
                out_f[t, first + i], out_t[t, first + i] = chosen[i], edges[chosen[i]][cut[i]]
            right = good[node] & (binned[np.arange(rows), chosen[node]] > cut[node])
            node = 2 * node + right
        sums_g, sums_h = (np.bincount(node, weights=v, minlength=leaves) for v in (grad, hess))
        out_l[t] = rate * sums_g / (sums_h + penalty)
        margin += out_l[t][node]
    return FlatTrees(out_f, out_t, out_l, base)
