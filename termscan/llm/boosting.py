"""Gradient-boosted trees with monotonic constraints, as flat numpy arrays.

Trees are complete binary trees of one depth, grown level by level on binned
features with second-order gains of the logistic loss.  A split on a
constrained feature must order its children's values, and their values stay
between bounds handed down, so the score never moves against the constraint.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """``feature`` and ``threshold`` of inner nodes, ``value`` of leaves, a row per tree."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; every step moves all rows down a level."""
        total = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner] if len(node) else 0
        return total


def train(
    x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2,
    bins: int = 64, smoothing: float = 1.0, least: float = 1e-3,
) -> Forest:
    """Fit to 0/1 labels; ``monotone`` has -1, 0 or 1 for each feature.

    With no rows or one class only, the forest is its constant base.
    """
    positive = float(y.sum())
    base = float(np.log((positive + 0.5) / (len(y) - positive + 0.5)))
    inner = (1 << depth) - 1
    n_features = x.shape[1]
    if len(y) == 0 or positive in (0.0, float(len(y))):
        empty = np.zeros((0, inner))
        return Forest(base, empty.astype(np.int64), empty, np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
    binned = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
    score = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.zeros(width)
            chosen = np.zeros(width, np.int64)
            cut = np.full(width, -1)
            left_of, right_of = np.zeros(width), np.zeros(width)
            for f in range(n_features):
                n_bins = len(edges[f]) + 1
                cell = (node - first) * n_bins + binned[:, f]
                g = np.bincount(cell, grad, width * n_bins).reshape(width, n_bins).cumsum(1)
                h = np.bincount(cell, hess, width * n_bins).reshape(width, n_bins).cumsum(1)
                gl, hl = g[:, :-1], h[:, :-1]
                if not gl.shape[1]:
                    continue
                gr, hr = g[:, -1:] - gl, h[:, -1:] - hl
                lo, hi = low[first : first + width, None], high[first : first + width, None]
                vl = np.clip(gl / (hl + smoothing), lo, hi)
                vr = np.clip(gr / (hr + smoothing), lo, hi)
                whole = np.clip(g[:, -1:] / (h[:, -1:] + smoothing), lo, hi)

                def reward(gs, hs, v):
                    return gs * v - 0.5 * (hs + smoothing) * v * v

                gain = reward(gl, hl, vl) + reward(gr, hr, vr) - reward(g[:, -1:], h[:, -1:], whole)
                gain[(hl < least) | (hr < least)] = 0
                if monotone[f]:
                    gain[monotone[f] * (vr - vl) < 0] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best + 1e-12
                best[better], chosen[better], cut[better] = top[better], f, at[better]
                left_of[better] = vl[np.arange(width), at][better]
                right_of[better] = vr[np.arange(width), at][better]
            for w in range(width):
                n = first + w
                a, b = 2 * n + 1, 2 * n + 2
                low[[a, b]], high[[a, b]] = low[n], high[n]
                if cut[w] < 0:
                    continue
                f = chosen[w]
                feature[n], threshold[n] = f, edges[f][cut[w]]
                if monotone[f]:
                    middle = (left_of[w] + right_of[w]) / 2
                    below, above = (a, b) if monotone[f] > 0 else (b, a)
                    high[below], low[above] = min(high[below], middle), max(low[above], middle)
            goes_right = x[np.arange(len(y)), feature[node]] > threshold[node]
            node = 2 * node + 1 + goes_right
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value = rate * np.clip(g / (h + smoothing), low[inner:], high[inner:])
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(base, np.array(features), np.array(thresholds), np.array(values))
