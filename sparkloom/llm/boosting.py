"""Gradient-boosted trees for several classes, on binned features, small enough to travel with a plan."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Softmax boosting with trees of fixed depth, kept as arrays: a node's feature, its threshold bin and, in leaves, its value."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, least_hessian: float = 2.0, ridge: float = 1.0, share: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least_hessian, ridge
        self.share = share  # of the features that a tree may split by, drawn anew for each by a fixed seed
        self.scale = np.ones(0)
        self.shift = np.zeros(0)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(b)
        width = self.bins + 1
        inner = 2**self.depth - 1
        feature, split = np.zeros(inner, int), np.full(inner, width, int)  # a threshold of ``width`` sends all to the left
        node = np.zeros(n, int)
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            best = np.full(count, 1e-6)
            total_g, total_h = np.bincount(at, g, count), np.bincount(at, h, count)
            for j in allowed:
                cell = at * width + b[:, j]
                cg = np.bincount(cell, g, count * width).reshape(count, width).cumsum(1)
                ch = np.bincount(cell, h, count * width).reshape(count, width).cumsum(1)
                rg, rh = total_g[:, None] - cg, total_h[:, None] - ch
                gain = cg**2 / (ch + self.ridge) + rg**2 / (rh + self.ridge) - (total_g**2 / (total_h + self.ridge))[:, None]
                gain[(ch < self.least) | (rh < self.least)] = -1
                k = gain.argmax(1)
                top = gain[np.arange(count), k]
                better = top > best
                best[better] = top[better]
                feature[first : first + count][better] = j
                split[first : first + count][better] = k[better]
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > split[node])
        leaf = node - inner
        leaves = 2**self.depth
        value = -self.rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + self.ridge)
        return feature, split, value

    def _walk(self, b: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, split, value = tree
        node, rows = np.zeros(len(b), int), np.arange(len(b))
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[rows, feature[node]] > split[node])
        return value[node - (2**self.depth - 1)]

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int) -> "BoostedTrees":
        self.classes = classes
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, one = self._bin(x), np.eye(classes)[y]
        prior = np.log(one.mean(0) + 1e-3)
        score, self.prior, self.trees = np.tile(prior, (len(x), 1)), prior, []
        draw = np.random.default_rng(0)
        for _ in range(self.rounds):
            p = softmax(score)
            row = []
            for c in range(classes):
                allowed = np.sort(draw.permutation(x.shape[1])[: max(1, round(self.share * x.shape[1]))])
                tree = self._tree(b, p[:, c] - one[:, c], np.maximum(p[:, c] * (1 - p[:, c]), 1e-6), allowed)
                score[:, c] += self._walk(b, tree)
                row.append(tree)
            self.trees.append(row)
        self.scale, self.shift = np.ones(classes), np.zeros(classes)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        out = np.tile(self.prior, (len(x), 1))
        for row in self.trees:
            for c, tree in enumerate(row):
                out[:, c] += self._walk(b, tree)
        return out

    def calibrate(self, x: np.ndarray | None, y: np.ndarray, steps: int = 200, rate: float = 0.5, pull: float = 0.02, rows: float = 10.0, scores: np.ndarray | None = None) -> "BoostedTrees":
        """Scale and shift each class's score to the holdout's (vector scaling), pulled towards leaving it as it is, the more the fewer labels: by ``rows`` labels' worth."""
        s, one, pull = np.clip(self.score(x) if scores is None else scores, -8, 8), np.eye(self.classes)[y], pull + rows / len(y)
        scale, shift = np.ones(self.classes), np.zeros(self.classes)
        for _ in range(steps):
            d = softmax(s * scale + shift) - one
            scale -= rate * 0.1 * ((d * s).mean(0) + pull * (scale - 1))
            shift -= rate * (d.mean(0) + pull * shift)
        self.scale, self.shift = np.maximum(scale, 0.05), shift
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(np.clip(self.score(x), -8, 8) * self.scale + self.shift)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)
