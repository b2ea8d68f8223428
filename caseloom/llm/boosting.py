"""Gradient-boosted trees for a binary label, small enough to send to every task."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Log-loss boosting over complete trees of fixed depth on binned features.

    ``cuts`` are quantiles of each feature, so a tree compares bin numbers;
    every tree is a feature and a bin for each inner node and a value for each leaf.
    """

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1).astype(np.uint8) if len(x) else np.zeros((0, len(self.cuts)), np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        n, width = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(width)]
        b = self.binned(x)
        flat = b.astype(np.int64) + np.arange(width) * self.bins
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), self.bins, np.int64)
        self.leaf = np.zeros((self.trees, 1 << self.depth))
        score = np.full(n, self.base)
        for t in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                nodes, first = 1 << level, (1 << level) - 1
                where = (at - first)[:, None] * (width * self.bins) + flat
                size = nodes * width * self.bins
                g = np.bincount(where.ravel(), np.repeat(grad, width), size).reshape(nodes, width, self.bins).cumsum(2)
                h = np.bincount(where.ravel(), np.repeat(hess, width), size).reshape(nodes, width, self.bins).cumsum(2)
                gt, ht = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + self.ridge) + (gt - g) ** 2 / (ht - h + self.ridge) - gt**2 / (ht + self.ridge)
                best = gain.reshape(nodes, -1).argmax(1)
                self.feature[t, first : first + nodes], self.cut[t, first : first + nodes] = best // self.bins, best % self.bins
                at = 2 * at + 1 + (b[np.arange(n), self.feature[t, at]] > self.cut[t, at])
            at -= inner
            g, h = np.bincount(at, grad, 1 << self.depth), np.bincount(at, hess, 1 << self.depth)
            self.leaf[t] = self.rate * g / (h + self.ridge)
            score += self.leaf[t][at]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        score, rows = np.full(len(b), self.base), np.arange(len(b))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            score += leaf[at - len(feature)]
        return score
