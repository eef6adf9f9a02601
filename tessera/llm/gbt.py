"""Gradient-boosted trees with monotonic constraints, trained on quantile bins, flattened into numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees in flat arrays: a node's children are left and left + 1; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Every row goes down every tree at once, one level after the other."""
        out = np.full(len(x), self.base)
        if not len(x) or not len(self.roots):
            return out
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            go = f >= 0
            right = x[rows, np.maximum(f, 0)] > self.threshold[node]
            node = np.where(go, self.left[node] + right, node)
        return out + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, leaf: float = 10.0, l2: float = 1.0) -> Forest:
    """monotone: 1, -1 or 0 for each feature; a split that would break it is not taken, and bounds go down the tree."""
    n, d = x.shape
    rate_of_ones = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    feature, threshold, left, value, roots = [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    if n and 0 < y.mean() < 1:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        flat = codes + np.arange(d) * bins
        sign = np.array(monotone)[:, None]
        score = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            root = node()
            roots.append(root)
            todo = [(root, np.arange(n), 0, -np.inf, np.inf)]
            while todo:
                at, rows, level, low, high = todo.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                mine = float(np.clip(-gs / (hs + l2), low, high))
                value[at] = rate * mine
                if level < depth and len(rows) >= 2 * leaf:
                    k = flat[rows].ravel()
                    hist = [np.bincount(k, np.repeat(w, d), d * bins).reshape(d, bins).cumsum(axis=1) for w in (g[rows], h[rows], np.ones(len(rows)))]
                    gl, hl, nl = hist
                    vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
                    gain = -(gl * vl + (gs - gl) * vr) - 0.5 * ((hl + l2) * vl**2 + (hs - hl + l2) * vr**2)
                    gain = np.where((nl < leaf) | (len(rows) - nl < leaf) | (sign * (vr - vl) < 0), -np.inf, gain)
                    for j in range(d):
                        gain[j, len(cuts[j]) :] = -np.inf
                    j, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[j, b] > -(gs * mine) - 0.5 * (hs + l2) * mine**2 + 1e-6:
                        feature[at], threshold[at] = int(j), float(cuts[j][b])
                        left[at] = node()
                        node()
                        goes = codes[rows, j] > b
                        mid = (vl[j, b] + vr[j, b]) / 2
                        bounds = [(low, high), (low, high)]
                        if monotone[j] > 0:
                            bounds = [(low, mid), (mid, high)]
                        elif monotone[j] < 0:
                            bounds = [(mid, high), (low, mid)]
                        for side in (0, 1):
                            todo.append((left[at] + side, rows[goes == side], level + 1, *bounds[side]))
                        continue
                score[rows] += value[at]
    if not roots:
        roots.append(node())
    return Forest(np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(value), np.array(roots, np.int32), depth, base)
