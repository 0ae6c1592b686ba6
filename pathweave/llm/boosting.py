"""Gradient boosted and random decision trees over small labelled samples, and their use as SQL expressions or arrays.

Training runs on the driver over a bounded sample of labelled rows that the caller gives; it is deterministic.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Tree:
    """Nodes in arrays: feature (-1 at a leaf), threshold, the two children, and the value of a leaf. x <= threshold goes left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            go_left = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)
        return self.value[at]

    def complete(self, depth: int) -> dict[str, list[float]]:
        """The tree as one with all its leaves at depth: features f, thresholds t of the inner nodes, values v of the leaves."""
        inner = (1 << depth) - 1
        at, f, t = [0] * (2 * inner + 1), [0] * inner, [1e300] * inner
        for k in range(inner):
            n = at[k]
            if self.feature[n] >= 0:
                f[k], t[k] = int(self.feature[n]), float(self.threshold[n])
                at[2 * k + 1], at[2 * k + 2] = int(self.left[n]), int(self.right[n])
            else:
                at[2 * k + 1] = at[2 * k + 2] = n
        return {"f": f, "t": t, "v": [float(self.value[n]) for n in at[inner:]]}


def sum_of_trees(start: float, trees: list[Tree], depth: int, features: Column) -> Column:
    """start plus the values of all trees for an array of features, as a SQL expression over a constant array of trees."""
    table = F.from_json(F.lit(json.dumps([t.complete(depth) for t in trees])), "array<struct<f:array<int>,t:array<double>,v:array<double>>>")
    levels = F.array(*[F.lit(0)] * depth)

    def leaf(tree: Column) -> Column:
        step = lambda n, _: 2 * n + 1 + F.when(F.get(features, F.get(tree["f"], n)) > F.get(tree["t"], n), 1).otherwise(0)
        return F.get(tree["v"], F.aggregate(levels, F.lit(0), step) - ((1 << depth) - 1))

    return F.aggregate(table, F.lit(float(start)), lambda total, tree: total + leaf(tree))


def grow(x: np.ndarray, goal: np.ndarray, weight: np.ndarray, depth: int, rng: np.random.Generator, among: int, least: int) -> Tree:
    """A least-squares tree on goal; a leaf's value is sum(goal) / sum(weight). Each split looks at so many random features."""
    feature, threshold, left, right, value = [], [], [], [], []

    def build(rows: np.ndarray, level: int) -> int:
        me = len(feature)
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, goal[rows].sum() / (weight[rows].sum() + 1e-9))):
            a.append(v)
        if level == depth or len(rows) < 2 * least or np.ptp(goal[rows]) == 0:
            return me
        best = (1e-9, None, None)
        whole = goal[rows].sum() ** 2 / len(rows)
        for f in rng.permutation(x.shape[1])[:among]:
            order = np.argsort(x[rows, f], kind="stable")
            v, g = x[rows[order], f], np.cumsum(goal[rows[order]])
            n = np.arange(1, len(rows) + 1)
            ends = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= least) & (n[:-1] <= len(rows) - least))
            if len(ends):
                gain = g[ends] ** 2 / n[ends] + (g[-1] - g[ends]) ** 2 / (len(rows) - n[ends]) - whole
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, (v[ends[k]] + v[ends[k] + 1]) / 2)
        if best[1] is not None:
            goes = x[rows, best[1]] <= best[2]
            feature[me], threshold[me] = int(best[1]), float(best[2])
            left[me] = build(rows[goes], level + 1)
            right[me] = build(rows[~goes], level + 1)
        return me

    build(np.arange(len(x)), 0)
    return Tree(*map(np.asarray, (feature, threshold, left, right, value)))


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 30, depth: int = 3, rate: float = 0.3, seed: int = 1) -> tuple[float, list[Tree]]:
    """Start and trees of a log-odds model of y (0 or 1); a leaf holds a Newton step times rate."""
    rng = np.random.default_rng(seed)
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    odds, out = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        tree = grow(x, y - p, p * (1 - p) + 0.05, depth, rng, x.shape[1], 8)
        tree.value = tree.value * rate
        odds = odds + tree.apply(x)
        out.append(tree)
    return start, out


def forest(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 8, seed: int = 1) -> list[Tree]:
    """Trees whose mean is the chance that y is 1: each on a bootstrap sample, each split on some of the features."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(grow(x[rows], y[rows].astype(float), np.ones(len(y)), depth, rng, max(1, int(np.sqrt(x.shape[1])) + 1), 3))
    return out


def threshold(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score from which on, over a labelled sample, the precision is kept; above all scores if none is."""
    order = np.argsort(-scores, kind="stable")
    hit = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.flatnonzero((hit >= precision) & np.append(scores[order][:-1] > scores[order][1:], True))
    return float(scores[order][last[-1]]) if len(last) else float("inf")
