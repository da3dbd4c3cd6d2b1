"""Gradient-boosted regression trees for a 0/1 label, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, threshold, value of each heap node

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                at = feature[node]
                inner = at >= 0
                right = x[rows, np.maximum(at, 0)] > threshold[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += value[node]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 1.0, ridge: float = 1.0) -> Boosted:
    """Logistic loss, Newton steps, histogram splits at quantiles of each feature."""
    y = y.astype(float)
    mean = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(mean / (1 - mean))))
    if len(y) < 4 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    for j, c in enumerate(cuts):  # rare values above a constant bulk still get a cut
        above = x[x[:, j] > (c[-1] if len(c) else 0), j]
        cuts[j] = np.unique(np.concatenate([c, np.quantile(above, [0, 0.25, 0.5, 0.75])])) if len(above) else c
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature = np.full(2 ** (depth + 1) - 1, -1)
        threshold, value = np.zeros(len(feature)), np.zeros(len(feature))
        node = np.zeros(len(y), np.int64)
        for level in range(depth + 1):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == k)
                if not len(own):
                    continue
                gs, hs = g[own].sum(), h[own].sum()
                value[k] = rate * gs / (hs + ridge)
                if level == depth:
                    continue
                best = 1e-6
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[own, j], g[own], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[own, j], h[own], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(hl < least) | (hs - hl < least)] = 0
                    b = int(gain.argmax())
                    if gain[b] > best:
                        best, feature[k], threshold[k] = gain[b], j, c[b]
                if feature[k] >= 0:
                    node[own] = 2 * k + 1 + (x[own, feature[k]] > threshold[k])
        margin += value[node]
        model.trees.append((feature, threshold, value))
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of a nondecreasing map from margins to probabilities."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, count, sum of margins
    for m, v in zip(margin[order], y[order].astype(float), strict=True):
        blocks.append([v, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    if not blocks:
        return np.zeros(1), np.zeros(1)
    sums, counts, at = np.array(blocks).T
    return at / counts, sums / counts


def folds(x: np.ndarray, y: np.ndarray, key: np.ndarray, k: int = 5, **settings) -> np.ndarray:
    """Margins of each row by a model that didn't see its fold."""
    out = np.zeros(len(y))
    for f in range(k):
        own = key % k == f
        if own.any():
            out[own] = fit(x[~own], y[~own], **settings).margin(x[own])
    return out
