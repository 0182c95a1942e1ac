"""Gradient-boosted trees for two classes and isotonic calibration, in numpy.

Meant for a bounded sample of dense features: it trains on the driver in a second or two, and a
model is a few small arrays that travel with the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: a split or a pass-through at every inner node."""

    feature: np.ndarray  # trees x inner nodes
    border: np.ndarray
    value: np.ndarray  # trees x leaves
    start: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, b, v in zip(self.feature, self.border, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > b[node])
            out += v[node - (2**self.depth - 1)]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, *, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 5, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over quantile bins; the same rows give the same trees.

    ``weight`` is how many rows each one stands for, 1 by default. Without rows, or with rows of one class, the model is a constant.
    """
    n, width = x.shape
    weight = np.ones(n) if weight is None else weight
    share = ((weight * y).sum() + 0.5) / (weight.sum() + 1.0)
    start, inner, leaves = float(np.log(share / (1 - share))), 2**depth - 1, 2**depth
    if n < 2 * least or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start, depth)
    borders = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    codes = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(borders)], 1)  # code > i: above border i
    raw = np.full(n, start)
    features, limits, values = [], [], []
    for _ in range(trees):
        p = sigmoid(raw)
        g, h = weight * (y - p), np.maximum(weight * p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        f_of, b_of = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best, choice = np.zeros(count), [None] * count
            total_g, total_h, total_n = (np.bincount(local, w, count) for w in (g, h, np.ones(n)))
            for f in range(width):
                m = len(borders[f])
                if not m:
                    continue
                key = local * (m + 1) + codes[:, f]
                left_g, left_h, left_n = (np.cumsum(np.bincount(key, w, count * (m + 1)).reshape(count, m + 1), 1)[:, :m] for w in (g, h, np.ones(n)))
                gain = left_g**2 / (left_h + ridge) + (total_g[:, None] - left_g) ** 2 / (total_h[:, None] - left_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                gain[(left_n < least) | (total_n[:, None] - left_n < least)] = 0
                top = gain.argmax(1)
                for c in np.flatnonzero(gain[np.arange(count), top] > best + 1e-9):
                    best[c], choice[c] = gain[c, top[c]], (f, top[c])
            right = np.zeros(n, bool)
            for c, found in enumerate(choice):
                if found:
                    f_of[first + c], b_of[first + c] = found[0], borders[found[0]][found[1]]
                    mine = local == c
                    right[mine] = codes[mine, found[0]] > found[1]
            node = 2 * node + 1 + right
        leaf = node - inner
        step = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        raw += step[leaf]
        features.append(f_of)
        limits.append(b_of)
        values.append(step)
    return Trees(np.array(features), np.array(limits), np.array(values), start, depth)


@dataclass
class Isotonic:
    """A rising line through blocks of pooled scores."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return np.interp(z, self.x, self.y)


def fit_isotonic(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
    """Pool adjacent violators; a block's value is smoothed a little so that none is 0 or 1. Weights as for trees."""
    if not len(z):
        return Isotonic(np.array([0.0]), np.array([0.5]))
    weight = np.ones(len(z)) if weight is None else weight
    spots, of = np.unique(z, return_inverse=True)  # rows of one score are one point, whatever block it joins
    sums, counts = np.bincount(of, weight * y), np.bincount(of, weight)
    blocks: list[list[float]] = []  # sum of y, rows, least z, greatest z
    for a, s, n in zip(spots.tolist(), sums.tolist(), counts.tolist(), strict=True):
        blocks.append([s, n, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    xs, ys = [], []
    for s, n, lo, hi in blocks:
        v = (s + 0.01) / (n + 0.02)
        xs += [lo, hi] if hi > lo else [lo]
        ys += [v, v] if hi > lo else [v]
    return Isotonic(np.array(xs), np.maximum.accumulate(np.array(ys)))
