"""Small models fitted on the driver from a bounded sample of rows of numbers."""

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class BoostedTrees:
    """Gradient-boosted regression trees of fixed depth on logistic loss.

    Features are cut at quantiles; a split maximises the second-order gain.
    """

    def __init__(self, rounds=60, depth=3, rate=0.15, bins=32, penalty=1.0, least=10):
        self.rounds, self.depth, self.rate, self.bins, self.penalty, self.least = rounds, depth, rate, bins, penalty, least
        self.base, self.trees = 0.0, []

    def fit(self, x, y):
        n, m = x.shape
        p = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        self.trees = []
        if n == 0 or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        f = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(code, cuts, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self._one(tree, x)
        return self

    def _grow(self, code, cuts, g, h):
        """Arrays over a complete binary tree: feature (-1: none), cut, value."""
        size = (1 << (self.depth + 1)) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        rows = {0: np.arange(len(g))}
        for node in range(size):
            r = rows.pop(node, None)
            if r is None:
                continue
            sg, sh = g[r].sum(), h[r].sum()
            value[node] = self.rate * sg / (sh + self.penalty)
            if node >= (1 << self.depth) - 1:
                continue
            best = (1e-6, None, None)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                k = len(c) + 1
                gl = np.bincount(code[r, j], g[r], k).cumsum()[:-1]
                hl = np.bincount(code[r, j], h[r], k).cumsum()[:-1]
                nl = np.bincount(code[r, j], minlength=k).cumsum()[:-1]
                gain = gl**2 / (hl + self.penalty) + (sg - gl) ** 2 / (sh - hl + self.penalty) - sg**2 / (sh + self.penalty)
                gain[(nl < self.least) | (len(r) - nl < self.least)] = 0
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (float(gain[b]), j, b)
            if best[1] is not None:
                _, j, b = best
                feature[node], cut[node] = j, cuts[j][b]
                left = code[r, j] <= b
                rows[2 * node + 1], rows[2 * node + 2] = r[left], r[~left]
        return feature, cut, value

    def _one(self, tree, x):
        feature, cut, value = tree
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            j = feature[at]
            inner = j >= 0
            left = x[np.arange(len(x)), np.maximum(j, 0)] <= cut[at]
            at = np.where(inner, 2 * at + np.where(left, 1, 2), at)
        return value[at]

    def margin(self, x):
        f = np.full(len(x), self.base)
        for t in self.trees:
            f += self._one(t, x)
        return f


class Isotonic:
    """A rising step function fitted by pooling adjacent violators, read off
    with straight lines between the middles of its steps."""

    def fit(self, score, y):
        order = np.argsort(score, kind="stable")
        blocks = []  # sum, count, sum of scores
        for s, v in zip(score[order], y[order]):
            blocks.append([float(v), 1, float(s)])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                a = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], a)]
        self.x = np.array([b[2] / b[1] for b in blocks] or [0.0])
        # One row of each label joins every step, so that no step says 0 or 1.
        self.y = np.maximum.accumulate(np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks] or [0.5]))
        return self

    def predict(self, score):
        return np.interp(score, self.x, self.y)


class Logistic:
    """Ridge logistic regression on standardised features by Newton's steps."""

    def fit(self, x, y, ridge=1.0, steps=15):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z = self._z(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(steps if len(x) else 0):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1])
            self.w += np.linalg.solve(hess, z.T @ (y - p) - ridge * self.w)
        return self

    def _z(self, x):
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])

    def margin(self, x):
        return self._z(x) @ self.w
