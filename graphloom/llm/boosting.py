"""A small gradient-boosted tree learner with isotonic calibration, for bounded samples.

The learner runs on the driver over a sample whose row bound the caller states
(thousands of rows of a dozen numbers); the fitted model is a few kilobytes and
travels to the executors in a closure, where scoring is vectorised.
"""

from __future__ import annotations

import numpy as np

BINS = 64
DEPTH = 3
ROUNDS = 80
RATE = 0.15
LEAF_ROWS = 8
RIDGE = 1.0
FOLDS = 4


class Trees:
    """Complete binary trees of fixed depth on binned features; deterministic."""

    def __init__(self, cuts: list[np.ndarray], start: float) -> None:
        self.cuts, self.start = cuts, start
        self.features: list[np.ndarray] = []
        self.splits: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros(x.shape, int)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, s, leaf in zip(self.features, self.splits, self.leaves, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (b[rows, f[at]] > s[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, Newton leaves, histogram splits."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    base = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(cuts, float(np.log(base / (1 - base))))
    b = model.bins(x)
    width = BINS + 1
    score = np.full(len(x), model.start)
    inner = 2**DEPTH - 1
    for _ in range(ROUNDS):
        p = sigmoid(score)
        grad, hess = y - p, p * (1 - p)
        feature, split = np.zeros(inner, int), np.full(inner, width)
        at = np.zeros(len(x), int)
        for depth in range(DEPTH):
            first, nodes = 2**depth - 1, 2**depth
            local = at - first
            best = np.full(nodes, 1e-9)
            for j in range(x.shape[1]):
                key = local * width + b[:, j]
                g, h, n = (np.bincount(key, w, nodes * width).reshape(nodes, width).cumsum(1) for w in (grad, hess, None))
                gt, ht, nt = g[:, -1:], h[:, -1:], n[:, -1:]
                gain = g**2 / (h + RIDGE) + (gt - g) ** 2 / (ht - h + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(n < LEAF_ROWS) | (nt - n < LEAF_ROWS)] = -1
                cell = gain.argmax(1)
                value = gain[np.arange(nodes), cell]
                better = value > best
                best[better] = value[better]
                feature[first : first + nodes][better] = j
                split[first : first + nodes][better] = cell[better]
            at = 2 * at + 1 + (b[np.arange(len(x)), feature[at]] > split[at])
        leaf = at - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value = RATE * g / (h + RIDGE)
        model.features.append(feature)
        model.splits.append(split)
        model.leaves.append(value)
        score += value[leaf]
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots (raw, probability), to be joined by straight lines."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, sum of raw, rows
    for r, t in zip(raw[order], y[order], strict=True):
        blocks.append([float(t), float(r), 1.0])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + c for a, c in zip(blocks[-1], last, strict=True)]
    # half a row of doubt keeps the ends off 0 and 1
    return np.array([b[1] / b[2] for b in blocks]), np.array([(b[0] + 0.5 * y.mean()) / (b[2] + 0.5) for b in blocks])


class Calibrated:
    """Trees on all rows, calibrated on predictions that each row's own trees have not seen."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray | None = None, views: list[np.ndarray] | None = None) -> None:
        """Few rows or one class: a constant (the base rate, 0.5 without rows).

        ``fold`` numbers the rows' folds; ``views[k]`` has the features as they
        are when nothing was learned from fold k (without views: x).  ``unseen``
        holds the calibrated predictions of the rows as unseen ones.
        """
        self.trees, self.constant = None, float((y.sum() + 0.5) / (len(y) + 1))
        self.unseen = np.full(len(y), self.constant)
        fold = np.arange(len(y)) % FOLDS if fold is None else fold
        held = [fold == k for k in range(FOLDS)]
        if min(y.sum(), len(y) - y.sum()) < 2 * FOLDS or not all(h.any() and len(np.unique(y[~h])) > 1 for h in held):
            return
        raw = np.zeros(len(y))
        for k, h in enumerate(held):
            seen = x if views is None else views[k]
            raw[h] = fit_trees(seen[~h], y[~h]).raw(seen[h])
        self.knots = isotonic(raw, y)
        self.trees = fit_trees(x, y)
        self.unseen = self._calibrated(raw)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.trees.raw(x) if self.trees else np.full(len(x), np.log(self.constant / (1 - self.constant)))

    def _calibrated(self, raw: np.ndarray) -> np.ndarray:
        return 0.999 * np.interp(raw, *self.knots) + 0.001 * sigmoid(raw)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Monotone in the raw score; a thousandth of the uncalibrated score keeps order within a plateau."""
        return np.full(len(x), self.constant) if self.trees is None else self._calibrated(self.raw(x))
