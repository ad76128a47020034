"""Small gradient-boosted trees on binned features (log loss), with isotonic calibration. numpy only."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        p = y.mean()
        self.base = float(np.log(p / (1 - p)))
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            tree: list[tuple] = []
            score += self.rate * self._grow(b, prob - y, prob * (1 - prob), tree)
            self.trees.append(tree)
        return self

    def _grow(self, b, g, h, tree) -> np.ndarray:
        """A tree as (node, feature, bin) splits and (node, None, value) leaves; children of n are 2n + 1 and 2n + 2."""
        out = np.zeros(len(g))
        todo = [(0, np.arange(len(g)), 0)]
        while todo:
            node, rows, level = todo.pop()
            best = (1e-6, None, None)
            gs, hs = g[rows].sum(), h[rows].sum()
            if level < self.depth and len(rows) >= 2 * self.least:
                for j in range(b.shape[1]):
                    n = len(self.edges[j]) + 1
                    col = b[rows, j]
                    gl = np.cumsum(np.bincount(col, g[rows], n))[:-1]
                    hl = np.cumsum(np.bincount(col, h[rows], n))[:-1]
                    nl = np.cumsum(np.bincount(col, minlength=n))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < self.least) | (len(rows) - nl < self.least)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
            if best[1] is None:
                value = -gs / (hs + 1)
                tree.append((node, None, float(value)))
                out[rows] = value
            else:
                tree.append((node, best[1], best[2]))
                left = b[rows, best[1]] <= best[2]
                todo += [(2 * node + 1, rows[left], level + 1), (2 * node + 2, rows[~left], level + 1)]
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, score = self._binned(x), np.full(len(x), self.base)
        for tree in self.trees:
            at, leaves = np.zeros(len(x), np.int64), {}
            for node, j, v in sorted(tree, key=lambda t: t[0]):
                if j is None:
                    leaves[node] = v
                else:
                    here = at == node
                    at[here] = np.where(b[here, j] <= v, 2 * node + 1, 2 * node + 2)
            value = np.zeros(max(leaves) + 1)
            value[list(leaves)] = list(leaves.values())
            score += self.rate * value[at]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Isotonic regression (pool adjacent violators) from raw scores to probabilities on rows not used for fitting."""
        raw = self.raw(x)
        by = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []
        for s, t in zip(raw[by], y[by]):
            blocks.append([float(t), 1.0, s])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                a = blocks.pop()
                blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2]]
        self.steps = np.array([b[2] for b in blocks])
        self.levels = np.array([b[0] / b[1] for b in blocks])
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return self.levels[np.maximum(0, np.searchsorted(self.steps, self.raw(x), "right") - 1)]
