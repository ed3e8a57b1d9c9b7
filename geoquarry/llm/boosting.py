"""Gradient-boosted trees and isotonic calibration on small dense arrays, for bounded training samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A full binary tree: a feature and a cut per inner node, a value per leaf."""

    features: np.ndarray
    cuts: np.ndarray
    values: np.ndarray

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """Return the leaf value of each row."""
        node = np.zeros(len(rows), np.int64)
        here = np.arange(len(rows))
        for _ in range(int(np.log2(len(self.values)))):
            right = rows[here, self.features[node]] > self.cuts[node]
            node = 2 * node + 1 + right
        return self.values[node - len(self.features)]


def _best_cut(rows: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, ridge: float) -> tuple[int, float]:
    """Return the feature and the cut that lower the loss most; (0, inf) sends all rows left."""
    best, feature, cut = 1e-9, 0, np.inf
    total = slope.sum() ** 2 / (curve.sum() + ridge)
    for index, marks in enumerate(edges):
        if not len(marks):
            continue
        bins = np.searchsorted(marks, rows[:, index], "left")
        left = np.cumsum(np.bincount(bins, slope, len(marks) + 1))[:-1]
        weight = np.cumsum(np.bincount(bins, curve, len(marks) + 1))[:-1]
        rest, other = slope.sum() - left, curve.sum() - weight
        gain = left**2 / (weight + ridge) + rest**2 / (other + ridge) - total
        gain[(weight < 1.0) | (other < 1.0)] = 0
        at = int(np.argmax(gain))
        if gain[at] > best:
            best, feature, cut = float(gain[at]), index, float(marks[at])
    return feature, cut


def grow(rows: np.ndarray, labels: np.ndarray, *, rounds: int, depth: int, rate: float, ridge: float = 1.0, bins: int = 64) -> tuple[float, list[Tree]]:
    """Fit logistic boosting and return the start value and the trees."""
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    start = float(np.log(share / (1 - share)))
    score = np.full(len(rows), start)
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins)))[:-1] for column in rows.T]
    trees = []
    inner = 2**depth - 1
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-score))
        slope, curve = labels - chance, np.maximum(chance * (1 - chance), 1e-6)
        features, cuts = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(rows), np.int64)
        for place in range(inner):
            here = np.flatnonzero(node == place)
            if len(here):
                features[place], cuts[place] = _best_cut(rows[here], edges, slope[here], curve[here], ridge)
                node[here] = 2 * place + 1 + (rows[here, features[place]] > cuts[place])
        leaf = node - inner
        up = np.bincount(leaf, slope, inner + 1)
        down = np.bincount(leaf, curve, inner + 1)
        trees.append(Tree(features, cuts, rate * up / (down + ridge)))
        score += trees[-1].values[leaf]
    return start, trees


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fit rising steps by pooling neighbours; return their right ends and smoothed heights."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, count, right end
    for at in order:
        if blocks and blocks[-1][2] == scores[at]:
            blocks[-1][0] += labels[at]
            blocks[-1][1] += 1
        else:
            blocks.append([float(labels[at]), 1.0, float(scores[at])])
    merged: list[list[float]] = []
    for block in blocks:
        merged.append(block)
        while len(merged) > 1 and merged[-2][0] * merged[-1][1] >= merged[-1][0] * merged[-2][1]:
            last = merged.pop()
            merged[-1] = [merged[-1][0] + last[0], merged[-1][1] + last[1], last[2]]
    ends = np.array([block[2] for block in merged])
    heights = np.array([(block[0] + 0.1) / (block[1] + 0.2) for block in merged])
    return ends, np.maximum.accumulate(heights)
