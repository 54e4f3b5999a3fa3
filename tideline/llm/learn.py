"""Small models that are fitted on bounded samples: boosted trees, isotonic steps, logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, bound: int, folds: int, held_out: int) -> DataFrame:
    """(id, label, part) of about `bound` training rows at most; part is 0 or 1.

    Training rows are those whose crc32(id as text) mod `folds` is not `held_out`. If there are more than `bound`, rows
    are chosen by a hash of the id. Rows without an id or label are left out; of an id's labels the largest counts.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    rows = rows.groupBy("id").agg(F.max("label").alias("label"))
    rows = rows.where(F.crc32(F.col("id").cast("string").cast("binary")) % folds != held_out)
    n = rows.count()
    share = min(1.0, bound / max(1, n))
    place = F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1_000_000))
    return rows.where(place < F.lit(int(share * 1_000_000))).withColumn("part", (F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(2))).cast("int"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class BoostedTrees:
    """Gradient-boosted trees with logistic loss over binned features."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, leaf: float = 3.0):
        self.trees, self.depth, self.rate, self.bins, self.leaf = trees, depth, rate, bins, leaf
        self.fitted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x: (n, features); y: 0 or 1. A sample with one class gives a constant."""
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T] if len(x) else []
        if not len(y) or y.min() == y.max():
            return self
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = sigmoid(score)
            tree = self._tree(binned, y - p, p * (1 - p))
            self.fitted.append(tree)
            score += self._values(tree, x)
        return self

    def _tree(self, binned, gradient, hessian):
        """Feature (or -1), threshold and value of each node of a complete tree."""
        size = 2 ** (self.depth + 1) - 1
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(gradient), np.int64)
        for k in range(size):
            rows = np.flatnonzero(node == k)
            if not len(rows):
                continue
            g, h = gradient[rows], hessian[rows]
            value[k] = self.rate * g.sum() / (h.sum() + 1.0)
            if 2 * k + 2 >= size or h.sum() < 2 * self.leaf:
                continue
            best, own = 1e-6, g.sum() ** 2 / (h.sum() + 1.0)
            for f, edges in enumerate(self.edges):
                if not len(edges):
                    continue
                left_g = np.cumsum(np.bincount(binned[rows, f], g, len(edges) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[rows, f], h, len(edges) + 1))[:-1]
                right_g, right_h = g.sum() - left_g, h.sum() - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - own
                gain[(left_h < self.leaf) | (right_h < self.leaf)] = 0
                b = int(gain.argmax())
                if gain[b] > best:
                    best, feature[k], threshold[k] = gain[b], f, edges[b]
            if feature[k] >= 0:
                right = binned[rows, feature[k]] > np.searchsorted(self.edges[feature[k]], threshold[k])
                node[rows] = 2 * k + 1 + right
        return feature, threshold, value

    @staticmethod
    def _values(tree, x: np.ndarray) -> np.ndarray:
        feature, threshold, value = tree
        node = np.zeros(len(x), np.int64)
        while True:
            f = feature[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return value[node]
            node[inner] = 2 * node[inner] + 1 + (x[inner, f[inner]] > threshold[node[inner]])

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.fitted:
            out += self._values(tree, x)
        return out


class Isotonic:
    """Non-decreasing calibration of margins by pooling adjacent violators, joined by lines."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        """Counts half a row of either class in every pool, so that no margin gets exactly 0 or 1."""
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []  # sum, count, sum of x
        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            pools.append([b, 1.0, a])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
        self.x = np.array([p[2] / p[1] for p in pools])
        self.y = np.maximum.accumulate(np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])) if pools else np.zeros(0)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y) if len(self.x) else sigmoid(x)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the last being the constant, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w
