"""Gradient-boosted trees over a dense matrix, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic gradient boosting with histogram splits on complete binary trees.

    Each tree is three arrays over its inner nodes (feature, cut) and leaves
    (value), so that prediction is a loop over depth, vectorised over rows.
    """

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 8, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.l2 = rounds, depth, rate, bins, least, l2
        self.bias, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> Boosted:
        n, m = x.shape
        w = np.ones(n) if w is None else w
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) if n else np.zeros(0) for j in range(m)]
        cuts = [np.unique(np.append(c, 0.0)) for c in cuts]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) if n else np.zeros((0, m), int)
        p = np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-4, 1 - 1e-4)
        self.bias, self.trees = float(np.log(p / (1 - p))), []
        f = np.full(n, self.bias)
        for _ in range(self.rounds if 0 < y.sum() < n else 0):
            q = 1 / (1 + np.exp(-f))
            g, h = w * (y - q), w * q * (1 - q) + 1e-9
            inner = 2**self.depth - 1
            feature, cut, node = np.zeros(inner, np.int32), np.full(inner, np.inf), np.zeros(n, np.int64)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                best = (1e-6, -1, 0)
                if len(rows) >= 2 * self.least:
                    gs, hs = g[rows], h[rows]
                    total_g, total_h = gs.sum(), hs.sum()
                    for j in range(m):
                        if not len(cuts[j]):
                            continue
                        b, size = binned[rows, j], len(cuts[j]) + 1
                        cg, ch, cn = (np.cumsum(np.bincount(b, v, size))[:-1] for v in (gs, hs, None))
                        ok = (cn >= self.least) & (len(rows) - cn >= self.least)
                        gain = np.where(ok, cg**2 / (ch + self.l2) + (total_g - cg) ** 2 / (total_h - ch + self.l2) - total_g**2 / (total_h + self.l2), 0)
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (float(gain[i]), j, i)
                if best[1] >= 0:
                    feature[k], cut[k] = best[1], cuts[best[1]][best[2]]
                node[rows] = 2 * k + 1 + (x[rows, feature[k]] > cut[k])
            leaf = node - inner
            value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.l2)
            f += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            f += value[node - len(feature)]
        return f


class Isotonic:
    """Monotone map from a score to a probability: pool adjacent violators, then interpolate."""

    def fit(self, s: np.ndarray, y: np.ndarray) -> Isotonic:
        if not len(s):
            self.x, self.p = np.array([0.0]), np.array([0.5])
            return self
        order = np.argsort(s, kind="stable")
        blocks: list[list[float]] = []  # sum of y, rows, lowest and highest score
        for score, label in zip(s[order], y[order]):
            if blocks and blocks[-1][3] == score:
                blocks[-1][0] += label
                blocks[-1][1] += 1
            else:
                blocks.append([float(label), 1, score, score])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                b = blocks.pop()
                blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
        self.x = np.array([v for b in blocks for v in b[2:4]], float)
        self.p = np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks for _ in (0, 1)])
        self.p = np.maximum.accumulate(self.p)
        return self

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.interp(s, self.x, self.p)
