"""Gradient-boosted trees for yes-or-no labels, on binned features, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete trees of one depth: per tree, the feature and threshold of each inner node and each leaf's value."""

    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of yes for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - (len(value) - 1)]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Newton boosting of the log loss; splits are the best of up to BINS quantiles a feature."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(depth, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)), float(np.log(mean / (1 - mean))))
    score = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            gains = np.zeros((width, count))
            cuts = np.zeros((width, count), np.int64)
            for f in range(width):
                if not len(edges[f]):
                    continue
                cell = (at - first) * (BINS + 1) + binned[:, f]
                sg = np.bincount(cell, g, count * (BINS + 1)).reshape(count, -1).cumsum(1)
                sh = np.bincount(cell, h, count * (BINS + 1)).reshape(count, -1).cumsum(1)
                right_g, right_h = sg[:, -1:] - sg, sh[:, -1:] - sh
                gain = sg**2 / (sh + l2) + right_g**2 / (right_h + l2) - sg[:, -1:] ** 2 / (sh[:, -1:] + l2)
                gain = np.where((sh >= least) & (right_h >= least), gain, 0.0)[:, : len(edges[f])]
                cuts[f] = gain.argmax(1)
                gains[f] = gain.max(1)
            best = gains.argmax(0)
            for k in range(count):
                if gains[best[k], k] > 1e-6:
                    model.feature[t, first + k] = best[k]
                    model.threshold[t, first + k] = edges[best[k]][cuts[best[k], k]]
            at = 2 * at + 1 + (x[np.arange(n), model.feature[t, at]] > model.threshold[t, at])
        leaf = at - (2**depth - 1)
        sums = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        model.value[t] = rate * sums[0] / (sums[1] + l2)
        score += model.value[t][leaf]
    return model
