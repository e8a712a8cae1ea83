"""A random forest of binary decision trees, held in flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class RandomForest:
    """Trees as arrays over their nodes: feature (-1 at leaves), threshold, children, and the share of positives."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    roots: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 10, leaf: int = 4, seed: int = 11) -> RandomForest:
        """Bootstrap samples, Gini splits over a random square root of the features at each node."""
        rnd, nodes, roots = np.random.default_rng(seed), [], []
        tried = max(1, int(np.sqrt(x.shape[1])))

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            good = y[rows].mean() if len(rows) else 0.5
            nodes.append([-1, 0.0, -1, -1, good])
            if level == depth or len(rows) < 2 * leaf or good in (0.0, 1.0):
                return at
            best = (2 * good * (1 - good) - 1e-9, None, None)
            for f in rnd.choice(x.shape[1], tried, replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, t = x[rows[order], f], y[rows[order]]
                n = np.arange(1, len(v))
                ok = (v[1:] > v[:-1]) & (n >= leaf) & (len(v) - n >= leaf)
                if not ok.any():
                    continue
                ones = np.cumsum(t)[:-1]
                p, q = ones / n, (t.sum() - ones) / (len(v) - n)
                cost = np.where(ok, (2 * p * (1 - p) * n + 2 * q * (1 - q) * (len(v) - n)) / len(v), 9)
                i = int(np.argmin(cost))
                if cost[i] < best[0]:
                    best = (cost[i], f, (v[i] + v[i + 1]) / 2)
            if best[1] is not None:
                low = x[rows, best[1]] <= best[2]
                a, b = grow(rows[low], level + 1), grow(rows[~low], level + 1)
                nodes[at][:4] = [int(best[1]), float(best[2]), a, b]
            return at

        for _ in range(trees):
            roots.append(grow(rnd.integers(0, len(y), len(y)) if len(y) else np.zeros(0, np.int64), 0))
        table = np.array(nodes, float)
        return cls(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of positives in the leaves that a row reaches."""
        out = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (live := np.flatnonzero(self.feature[at] >= 0)).size:
                now = at[live]
                low = x[live, self.feature[now]] <= self.threshold[now]
                at[live] = np.where(low, self.left[now], self.right[now])
            out += self.share[at]
        return out / max(len(self.roots), 1)
