"""Gradient-boosted trees for a bounded training sample, and their compilation into Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A leaf (value), or a split: `feature` <= `cut` goes left."""

    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 20) -> tuple[float, list[Node]]:
    """Bias and trees of a logistic model of y (0 or 1) on x (rows, features), fitted by second-order boosting on binned features."""
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin, out = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(binned, cuts, y - p, np.maximum(p * (1 - p), 1e-9), np.arange(len(y)), depth, rate, bins, least)
        if tree.left is None:
            break
        margin += predict(tree, x)
        out.append(tree)
    return bias, out


def _grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, rate: float, bins: int, least: int) -> Node:
    total_g, total_h = g[rows].sum(), h[rows].sum()
    leaf = Node(value=float(rate * total_g / (total_h + 1.0)))
    best = (1e-3, -1, -1)
    if depth and len(rows) >= 2 * least:
        for j in range(binned.shape[1]):
            if not len(cuts[j]):
                continue
            b = binned[rows, j]
            sums = [np.cumsum(np.bincount(b, w, minlength=bins + 1)) for w in (g[rows], h[rows], np.ones(len(rows)))]
            left_g, left_h, n = (s[: len(cuts[j])] for s in sums)
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            gain[(n < least) | (len(rows) - n < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), j, k)
    _, j, k = best
    if j < 0:
        return leaf
    goes = binned[rows, j] <= k
    down = [_grow(binned, cuts, g, h, part, depth - 1, rate, bins, least) for part in (rows[goes], rows[~goes])]
    return Node(leaf.value, j, float(cuts[j][k]), *down)


def predict(tree: Node, x: np.ndarray) -> np.ndarray:
    if tree.left is None:
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.cut, predict(tree.left, x), predict(tree.right, x))


def tree_column(tree: Node, names: list[str]) -> Column:
    """The tree as nested CASE WHEN over the feature columns."""
    if tree.left is None:
        return F.lit(tree.value)
    return F.when(F.col(names[tree.feature]) <= tree.cut, tree_column(tree.left, names)).otherwise(tree_column(tree.right, names))


def logistic(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


Rule = tuple[tuple[int, bool, float], ...]


def rules(trees: list[Node]) -> list[Rule]:
    """All distinct paths of the trees, from the root to any node, as conjunctions of (feature, at most, cut)."""
    found: dict[Rule, None] = {}

    def walk(node: Node, path: Rule) -> None:
        if path:
            found.setdefault(tuple(sorted(set(path))), None)
        if node.left is not None:
            walk(node.left, (*path, (node.feature, True, node.cut)))
            walk(node.right, (*path, (node.feature, False, node.cut)))

    for tree in trees:
        walk(tree, ())
    return list(found)


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, most, cut in rule:
        out &= (x[:, j] <= cut) == most
    return out


def rule_column(rule: Rule, names: list[str]) -> Column:
    out = F.lit(True)
    for j, most, cut in rule:
        out = out & (F.col(names[j]) <= cut if most else F.col(names[j]) > cut)
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of an L1-penalised logistic model of y on a, by accelerated proximal gradient; the bias isn't penalised."""
    n = len(y)
    full = np.concatenate([np.ones((n, 1)), a], axis=1)
    v = np.ones(full.shape[1])
    for _ in range(30):  # the largest curvature, by power iteration
        v = full.T @ (full @ v)
        top = np.linalg.norm(v)
        v /= top
    rate = 4 * n / (1.02 * top)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    w = np.zeros(full.shape[1])
    w[0] = np.log(share / (1 - share))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ ahead, -500, 500)))
        new = ahead - rate * (full.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]
