"""Gradient-boosted regression trees and isotonic regression in numpy, for bounded training samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Node:
    """A leaf has feature -1; rows with x[feature] <= threshold go left."""

    value: float
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def cut_points(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]


def grow(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float) -> Node:
    total_g, total_h = g.sum(), h.sum()
    leaf = Node(float(-total_g / (total_h + ridge)))
    if depth == 0 or total_h < 2 * least:
        return leaf
    best_gain, best = 1e-6, None
    for j, at in enumerate(cuts):
        if not len(at):
            continue
        left_g = np.bincount(bins[:, j], g, len(at) + 1).cumsum()[:-1]
        left_h = np.bincount(bins[:, j], h, len(at) + 1).cumsum()[:-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - total_g**2 / (total_h + ridge)
        gain[(left_h < least) | (right_h < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best_gain:
            best_gain, best = gain[k], (j, k)
    if best is None:
        return leaf
    j, k = best
    goes = bins[:, j] <= k
    return Node(
        leaf.value, j, float(cuts[j][k]),
        grow(bins[goes], cuts, g[goes], h[goes], depth - 1, least, ridge),
        grow(bins[~goes], cuts, g[~goes], h[~goes], depth - 1, least, ridge),
    )


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> tuple[float, list[Node]]:
    """Logistic boosting: the base log-odds and the trees, leaf values already multiplied by the rate at use."""
    p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(p / (1 - p)))
    if len(y) < 2 or x.shape[1] == 0:
        return base, []
    cuts = cut_points(x, bins)
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    margin, out = np.full(len(y), base), []
    for _ in range(trees):
        q = sigmoid(margin)
        tree = grow(binned, cuts, q - y, np.maximum(q * (1 - q), 1e-6), depth, least, ridge)
        if tree.left is None:
            break
        out.append(tree)
        margin += rate * apply(tree, x)
    return base, out


def apply(tree: Node, x: np.ndarray) -> np.ndarray:
    if tree.left is None:
        return np.full(len(x), tree.value)
    goes = x[:, tree.feature] <= tree.threshold
    out = np.empty(len(x))
    out[goes], out[~goes] = apply(tree.left, x[goes]), apply(tree.right, x[~goes])
    return out


def margins(model: tuple[float, list[Node]], x: np.ndarray, rate: float = 0.2) -> np.ndarray:
    base, trees = model
    return base + rate * sum((apply(t, x) for t in trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, calibrated value), for np.interp."""
    if not len(score):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, lowest, highest score
    for s, v in zip(score[order], y[order].astype(float), strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    at = np.array([x for b in blocks for x in ((b[2], b[3]) if b[3] > b[2] else (b[2],))])
    value = np.array([b[0] / b[1] for b in blocks for _ in range(2 if b[3] > b[2] else 1)])
    return at, value
