"""Gradient-boosted trees for two classes over dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth; node k has children 2k+1 and 2k+2."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; values above go right
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 0.4, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over quantile bins; deterministic."""
    n, p = x.shape
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    inner, leaves = 2**depth - 1, 2**depth
    if n < 10 or y.min() == y.max():
        return Trees(base, depth, np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(p)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(p)], axis=1)
    margin, out = np.full(n, base), []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = y - prob, prob * (1 - prob)
        feature, cut, node = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            local = node - first
            for j in range(p):
                size = len(edges[j]) + 1
                if size < 2:
                    continue
                at = local * size + binned[:, j]
                gs = np.bincount(at, g, width * size).reshape(width, size).cumsum(axis=1)
                hs = np.bincount(at, h, width * size).reshape(width, size).cumsum(axis=1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least) | (ha - hl < least)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = j
                cut[first : first + width][better] = edges[j][k[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        spot = node - inner
        leaf = rate * np.bincount(spot, g, leaves) / (np.bincount(spot, h, leaves) + ridge)
        margin += leaf[spot]
        out.append((feature, cut, leaf))
    return Trees(base, depth, *(np.stack(c) for c in zip(*out, strict=True)))


@dataclass
class Isotonic:
    """A rising step function, joined by straight lines."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value) if len(self.at) else 1 / (1 + np.exp(-x))


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; each pool counts one more row of the overall mean, so that none is at 0 or 1."""
    if len(score) < 20 or y.min() == y.max():
        return Isotonic(np.zeros(0), np.zeros(0))
    order = np.argsort(score, kind="stable")
    mean = float(y.mean())
    pools: list[list[float]] = []  # sum, rows, least and most score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, 1.0, s, s])
        while len(pools) > 1 and (pools[-2][3] == pools[-1][2] or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    at = np.array([x for p in pools for x in ((p[2], p[3]) if p[3] > p[2] else (p[2],))])
    value = np.array([(p[0] + mean) / (p[1] + 1) for p in pools for _ in range(2 if p[3] > p[2] else 1)])
    return Isotonic(at, np.maximum.accumulate(value))
