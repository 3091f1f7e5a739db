"""Histogram gradient-boosted trees for two classes, small enough to train on the driver.

Training takes a bounded sample.  A trained model is a set of flat arrays, which score
either by vectorised numpy traversal or as one SQL expression of nested CASEs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Trees:
    """All trees, one after another: split feature (-1 at leaves), threshold, left child (right is next to it), value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of ``x``; every row walks every tree by array lookups, level by level."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                right = x[rows, np.maximum(f, 0)] > self.threshold[node]
                node = np.where(f < 0, node, self.left[node] + right)
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -60.0, 60.0)))

    def midway(self, x: np.ndarray) -> Trees:
        """The same trees over the rows ``x`` they learned from, each threshold moved midway between the values beside it, so that a feature's rounding does not change a row's side."""
        threshold = self.threshold.copy()
        for node in np.flatnonzero(self.feature >= 0):
            values, at = x[:, self.feature[node]], self.threshold[node]
            threshold[node] = (values[values <= at].max() + values[values > at].min()) / 2
        return replace(self, threshold=threshold)

    def column(self, features: list[Column]) -> Column:
        """The same score as an expression over feature columns."""

        def tree(node: int) -> Column:
            if self.feature[node] < 0:
                return F.lit(float(self.value[node]))
            left = int(self.left[node])
            return F.when(features[self.feature[node]] > F.lit(float(self.threshold[node])), tree(left + 1)).otherwise(tree(left))

        total = F.lit(float(self.base))
        for root in self.roots:
            total = total + tree(int(root))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 5) -> Trees:
    """Fit by second-order boosting of the logistic loss on quantile bins.

    Without rows, or with one class only, the model is the (smoothed) base rate.
    """
    n = len(y)
    rate0 = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(rate0 / (1.0 - rate0)))
    feature, threshold, left, value, roots = [-1], [0.0], [0], [0.0], []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        margin = np.full(n, base)
        for _ in range(rounds):
            p = 1.0 / (1.0 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1.0 - p), 1e-9)
            root = len(feature)
            roots.append(root)
            feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
            open_nodes = [(root, np.arange(n), 0)]
            while open_nodes:
                node, rows, level = open_nodes.pop()
                G, H = g[rows].sum(), h[rows].sum()
                value[node] = float(rate * G / (H + l2))
                margin[rows] += value[node]
                best = (1e-6, -1, 0)
                if level < depth and len(rows) >= 2 * least:
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        b = binned[rows, f]
                        gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                        nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                        gain = gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2)
                        gain[(nl < least) | (len(rows) - nl < least)] = -np.inf
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, k)
                if best[1] >= 0:
                    _, f, k = best
                    margin[rows] -= value[node]
                    go_left = binned[rows, f] <= k
                    feature[node], threshold[node], left[node] = f, float(edges[f][k]), len(feature)
                    for child in (rows[go_left], rows[~go_left]):
                        open_nodes.append((len(feature), child, level + 1))
                        feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots, np.int64), depth, base)
