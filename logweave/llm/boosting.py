"""Histogram gradient-boosted trees, flattened into arrays.

Features are cut into at most ``BINS`` quantile bins; a level's histograms of gradients and hessians over
(node, feature, bin) are one ``bincount``. Trees are complete to their depth: node ``i`` has the children ``2i+1``
and ``2i+2``, a node that does not split sends all rows left. So a forest is three arrays (feature, threshold, leaf
value), and rows traverse all trees at once by numpy indexing.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 64


@dataclass
class Forest:
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); a row goes right if its value is greater
    leaf: np.ndarray  # (trees, leaves)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 of each row of ``x``."""
        out = np.full(len(x), self.base)
        trees, inner = self.feature.shape
        if not len(x) or not trees:
            return out
        tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), trees), dtype=np.int64)
        while node[0, 0] < inner:
            right = x[row, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        return out + self.leaf[tree, node - inner].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(
    x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, least_rows: float = 10.0, ridge: float = 1.0,
) -> Forest:
    """Boost logistic loss. With no rows the forest says 1/2, with one class that class's smoothed rate."""
    n, width = x.shape
    rate_1 = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate_1 / (1 - rate_1)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if n == 0 or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(n, base)
    features, thresholds, values = (np.zeros((trees, k), kind) for k, kind in ((inner, np.int32), (inner, float), (leaves, float)))
    thresholds[:] = np.inf
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, dtype=np.int64)  # within the level
        for level in range(depth):
            nodes = 1 << level
            place = ((node[:, None] * width + np.arange(width)) * BINS + binned).ravel()
            g, h, c = (np.bincount(place, np.repeat(w, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(axis=2)
                       for w in (grad, hess, np.ones(n)))
            g_all, h_all, c_all = g[:, :1, -1:], h[:, :1, -1:], c[:, :1, -1:]
            gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain[(c < least_rows) | (c_all - c < least_rows)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            feature, cut = best // BINS, best % BINS
            splits = gain.reshape(nodes, -1).max(axis=1) > 1e-6
            for k in np.flatnonzero(splits):
                features[t, nodes - 1 + k] = feature[k]
                thresholds[t, nodes - 1 + k] = cuts[feature[k]][cut[k]]
            right = splits[node] & (binned[np.arange(n), feature[node]] > cut[node])
            node = 2 * node + right
        g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        values[t] = -rate * g / (h + ridge)
        margin += values[t][node]
    return Forest(base, features, thresholds, values)
