"""Gradient-boosted trees: fitted with numpy on a bounded table, applied as one SQL expression."""

from __future__ import annotations

import numpy as np


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, least: int, shrink: float):
    total_g, total_h = grad[rows].sum(), hess[rows].sum()
    leaf = ("leaf", float(shrink * total_g / (total_h + 1.0)))
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        order = rows[np.argsort(x[rows, f], kind="stable")]
        values = x[order, f]
        g, h = np.cumsum(grad[order]), np.cumsum(hess[order])
        cut = np.flatnonzero(values[1:] > values[:-1])
        cut = cut[(cut + 1 >= least) & (len(order) - cut - 1 >= least)]
        if not len(cut):
            continue
        gain = g[cut] ** 2 / (h[cut] + 1.0) + (total_g - g[cut]) ** 2 / (total_h - h[cut] + 1.0) - total_g**2 / (total_h + 1.0)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float((values[cut[k]] + values[cut[k] + 1]) / 2))
    if best[1] is None:
        return leaf
    _, f, at = best
    low = x[rows, f] <= at
    return ("split", f, at, _grow(x, grad, hess, rows[low], depth - 1, least, shrink), _grow(x, grad, hess, rows[~low], depth - 1, least, shrink))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if tree[0] == "leaf":
        return np.full(len(x), tree[1])
    low = x[:, tree[1]] <= tree[2]
    out = np.empty(len(x))
    out[low], out[~low] = _apply(tree[3], x[low]), _apply(tree[4], x[~low])
    return out


class BoostedTrees:
    """Logistic boosting with second-order leaf weights; deterministic for given rows."""

    def __init__(self, rounds: int = 30, depth: int = 3, shrink: float = 0.3, least: int = 10) -> None:
        self.rounds, self.depth, self.shrink, self.least = rounds, depth, shrink, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = _grow(x, y - p, p * (1 - p), np.arange(len(y)), self.depth, self.least, self.shrink)
            self.trees.append(tree)
            margin += _apply(tree, x)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + sum(_apply(t, x) for t in self.trees))))

    def sql(self, features: list[str]) -> str:
        """SQL for the probability, given SQL for each feature."""

        def text(tree) -> str:
            if tree[0] == "leaf":
                return f"{tree[1]!r}D"
            return f"if({features[tree[1]]} <= {tree[2]!r}D, {text(tree[3])}, {text(tree[4])})"

        return f"1D / (1D + exp(-({' + '.join([f'{self.start!r}D', *map(text, self.trees)])})))"
