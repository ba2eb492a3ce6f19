"""Small gradient-boosted trees on binned features, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Boosted trees of fixed depth for a yes/no label, with a logistic loss.

    A tree of depth d asks 2**d - 1 questions; node i has children 2i + 1 and 2i + 2. Features are
    cut at quantiles of the rows it is fitted on.
    """

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.2, penalty: float = 1.0):
        self.depth, self.rounds, self.rate, self.penalty = depth, rounds, rate, penalty

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        self.trees = []
        score = np.full(len(y), self.base)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS)
            for n in range(inner):
                own = node == n
                if own.sum() >= 8:
                    feature[n], cut[n] = self._best(binned[own], g[own], h[own])
                right = own & (binned[np.arange(len(y)), feature[n]] > cut[n])
                node[own] = 2 * n + 1
                node[right] = 2 * n + 2
            leaf = node - inner
            value = np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.penalty)
            self.trees.append((feature, cut, self.rate * value))
            score += self.rate * value[leaf]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def _best(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        best, found = 1e-9, (0, BINS)
        total_g, total_h = g.sum(), h.sum()
        for f in range(b.shape[1]):
            gs, hs = np.cumsum(np.bincount(b[:, f], g, BINS + 1)), np.cumsum(np.bincount(b[:, f], h, BINS + 1))
            gain = gs**2 / (hs + self.penalty) + (total_g - gs) ** 2 / (total_h - hs + self.penalty) - total_g**2 / (total_h + self.penalty)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), (f, k)
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        binned, rows = self._bin(x), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b for which 1 / (1 + exp(-(a * score + b))) fits y best (Newton's method)."""
    x = np.stack([score, np.ones_like(score)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + 1e-3 * (w - [1.0, 0.0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(curve, slope)
    return float(w[0]), float(w[1])


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability of a positive row from which on the given share of rows is right; above 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
    good = np.flatnonzero((right >= precision) & np.append(p[order][1:] != p[order][:-1], True) & (p[order] >= p[y == 1].min(initial=np.inf)))
    return float(p[order][good[-1]]) if len(good) else 1.1
