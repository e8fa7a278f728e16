"""Gradient-boosted trees for a binary label, in numpy: small enough to train on the driver and to send to every task."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """A complete binary tree: `feature`/`cut` of the inner nodes by level, `value` of the leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            right = x[rows, self.feature[node]] > self.cut[node]
            node = 2 * node + 1 + right
        return self.value[node - (2**self.depth - 1)]


@dataclass
class Boosted:
    """Log-odds as a sum of trees, and the map from log-odds to calibrated probability (Platt)."""

    base: float
    trees: list[Tree] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.predict(x)
        return out

    def proba(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))


def _grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, l2: float, bins: int) -> tuple[Tree, np.ndarray]:
    n, f = binned.shape
    inner = 2**depth - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(n, np.int64)
    offset = np.arange(f) * bins
    for level in range(depth):
        first, width = 2**level - 1, 2**level
        local = node - first
        key = (local[:, None] * (f * bins) + offset + binned).ravel()
        size = width * f * bins
        gs = np.bincount(key, np.repeat(g, f), size).reshape(width, f, bins).cumsum(2)
        hs = np.bincount(key, np.repeat(h, f), size).reshape(width, f, bins).cumsum(2)
        gt, ht = gs[:, :, -1:], hs[:, :, -1:]
        gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
        gain[(hs < 1) | (ht - hs < 1)] = -1
        gain[:, :, -1] = -1
        best = gain.reshape(width, -1).argmax(1)
        for k in range(width):
            fi, b = divmod(int(best[k]), bins)
            if gain[k, fi, b] > 1e-9 and b < len(cuts[fi]):
                feature[first + k], cut[first + k] = fi, cuts[fi][b]
        split_bin = np.array([np.searchsorted(cuts[feature[first + k]], cut[first + k]) for k in range(width)])
        right = binned[np.arange(n), feature[node]] > split_bin[local]
        node = 2 * node + 1 + right
    leaf = node - inner
    value = -np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
    return Tree(feature, cut, value, depth), leaf


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0, bins: int = 32, held: tuple[np.ndarray, np.ndarray] | None = None) -> Boosted:
    """Boosted trees by the logistic loss, calibrated on `held`, rows and labels set apart. Deterministic."""
    xt, yt = x.astype(float), y.astype(float)
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(xt[:, j])
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(middle if len(middle) < bins else np.unique(np.quantile(middle, np.linspace(0, 1, bins - 1))))
    binned = np.stack([np.searchsorted(cuts[j], xt[:, j], side="left") for j in range(x.shape[1])], 1)
    p0 = float(np.clip(yt.mean(), 1e-3, 1 - 1e-3))
    model = Boosted(float(np.log(p0 / (1 - p0))))
    score = np.full(len(yt), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree, leaf = _grow(binned, cuts, p - yt, np.maximum(p * (1 - p), 1e-6), depth, l2, bins)
        tree.value = tree.value * rate
        model.trees.append(tree)
        score += tree.value[leaf]
    if held is not None and len(held[1]) > 20:
        _calibrate(model, model.raw(held[0].astype(float)), held[1].astype(float))
    return model


def _calibrate(model: Boosted, z: np.ndarray, y: np.ndarray) -> None:
    """Platt's sigmoid by Newton steps, with his smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.array([1.0, 0.0])
    a = np.stack([z, np.ones_like(z)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a @ w)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-6 * np.eye(2), a.T @ (p - t))
        w -= step
        if abs(step).max() < 1e-8:
            break
    model.slope, model.shift = float(w[0]), float(w[1])
