"""Small gradient-boosted trees for binary labels, for bounded labelled tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Tree:
    """Complete binary tree: node i has the children 2i+1 and 2i+2."""
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def value(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        inner = len(self.feature)
        for _ in range(inner.bit_length()):
            right = x[rows, self.feature[node]] > self.threshold[node]
            node = 2 * node + 1 + right
        return self.leaf[node - inner]


@dataclass
class Boosted:
    """Sum of trees, then a line fitted on held-out rows that calibrates the score."""
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for t in self.trees:
            total += t.value(x)
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.raw(x) + self.shift)


def _fit_tree(x, grad, hess, cuts, depth, l2):
    inner = 2 ** depth - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(x), np.int64)
    for i in range(inner):
        own = np.flatnonzero(node == i)
        best = 0.0
        if len(own) >= 10:
            g, h = grad[own], hess[own]
            G, H = g.sum(), h.sum()
            for f, points in enumerate(cuts):
                if not len(points):
                    continue
                b = np.searchsorted(points, x[own, f], side="left")
                gl = np.cumsum(np.bincount(b, g, len(points) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h, len(points) + 1))[:-1]
                gain = gl ** 2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G ** 2 / (H + l2)
                gain[(hl < 1) | (H - hl < 1)] = 0
                k = int(gain.argmax())
                if gain[k] > best + 1e-9:
                    best, feature[i], threshold[i] = gain[k], f, points[k]
        node[own] = 2 * i + 1 + (x[own, feature[i]] > threshold[i])
    leaf = np.zeros(inner + 1)
    for j in range(inner + 1):
        own = node == inner + j
        leaf[j] = -grad[own].sum() / (hess[own].sum() + l2) if own.any() else 0.0
    return Tree(feature, threshold, leaf)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0,
        bins: int = 32) -> Boosted:
    """Newton boosting on the logistic loss; the last third of the rows calibrates."""
    n = len(x) * 2 // 3
    xt, yt = x[:n], y[:n]
    cuts = [np.unique(np.quantile(xt[:, f], np.linspace(0, 1, bins + 1)[:-1])) for f in range(x.shape[1])]
    p = min(max(yt.mean(), 1e-3), 1 - 1e-3)
    model = Boosted(base=float(np.log(p / (1 - p))))
    z = np.full(n, model.base)
    for _ in range(rounds):
        q = sigmoid(z)
        t = _fit_tree(xt, q - yt, q * (1 - q), cuts, depth, l2)
        t.leaf *= rate
        model.trees.append(t)
        z += t.value(xt)
    # Platt's line on the held-out rows, by Newton steps with a little ridge.
    r, t = model.raw(x[n:]), y[n:]
    a = np.array([1.0, 0.0])
    m = np.stack([r, np.ones_like(r)], 1)
    for _ in range(30):
        q = sigmoid(m @ a)
        g = m.T @ (q - t) + 0.1 * (a - [1.0, 0.0])
        h = (m * (q * (1 - q))[:, None]).T @ m + 0.1 * np.eye(2)
        a = a - np.linalg.solve(h, g)
    model.slope, model.shift = float(a[0]), float(a[1])
    return model


def threshold_for(prob: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Lowest threshold whose kept rows have at least ``precision``; above 1 if there is none."""
    order = np.argsort(-prob, kind="stable")
    hit = np.cumsum(y[order])
    good = np.flatnonzero(hit / np.arange(1, len(y) + 1) >= precision)
    ends = [k for k in good if k + 1 == len(y) or prob[order[k + 1]] < prob[order[k]]]
    return float(prob[order[ends[-1]]]) if ends else 1.1
