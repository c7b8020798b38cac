"""Gradient-boosted trees for a yes-or-no label, in numpy; for bounded training tables on the driver."""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete trees of one depth: arrays of feature, threshold (go right above it) and leaf value."""

    def __init__(self, depth: int, start: float, features: np.ndarray, thresholds: np.ndarray, leaves: np.ndarray) -> None:
        self.depth, self.start, self.features, self.thresholds, self.leaves = depth, start, features, thresholds, leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (1 << self.depth) + 1]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, enough: float = 0.004) -> Trees:
    """Second-order boosting of the logistic loss on histograms of quantile bins; no more trees once the mean loss is below ``enough``."""
    weight = np.ones(len(y)) if weight is None else weight
    mean = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1) if len(x) else np.zeros(x.shape, dtype=int)
    n_inner, n_leaf = (1 << depth) - 1, 1 << depth
    score = np.full(len(y), start)
    features, thresholds, leaves = np.zeros((rounds, n_inner), dtype=np.int64), np.full((rounds, n_inner), np.inf), np.zeros((rounds, n_leaf))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            at = node - first
            best = np.full(n, 1e-6)
            total_g, total_h = np.bincount(at, g, n), np.bincount(at, h, n)
            whole = total_g**2 / (total_h + ridge)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = at * (len(e) + 1) + binned[:, f]
                left_g = np.cumsum(np.bincount(key, g, n * (len(e) + 1)).reshape(n, -1), axis=1)[:, :-1]
                left_h = np.cumsum(np.bincount(key, h, n * (len(e) + 1)).reshape(n, -1), axis=1)[:, :-1]
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - whole[:, None]
                k = gain.argmax(axis=1)
                for i in np.flatnonzero(gain[np.arange(n), k] > best):
                    best[i] = gain[i, k[i]]
                    features[t, first + i], thresholds[t, first + i] = f, e[k[i]]
            node = 2 * node + 1 + (x[np.arange(len(x)), features[t, node]] > thresholds[t, node])
        at = node - n_inner
        leaves[t] = -rate * np.bincount(at, g, n_leaf) / (np.bincount(at, h, n_leaf) + ridge)
        score += leaves[t][at]
        loss = (weight * np.logaddexp(0.0, np.where(y > 0.5, -score, score))).sum() / max(weight.sum(), 1e-9)
        if loss < enough:
            features, thresholds, leaves = features[: t + 1], thresholds[: t + 1], leaves[: t + 1]
            break
    return Trees(depth, start, features, thresholds, leaves)
