"""Gradient-boosted trees of depth two for yes-or-no labels, fitted on the driver from a bounded table
of features and written out as a column expression."""
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """A split, then a split on either side: (feature, threshold) and four leaf values."""

    root: tuple[int, float]
    left: tuple[int, float]
    right: tuple[int, float]
    leaves: tuple[float, float, float, float]

    def values(self, x: np.ndarray) -> np.ndarray:
        below = x[:, self.root[0]] < self.root[1]
        l, r = (x[:, f] < t for f, t in (self.left, self.right))
        return np.where(below, np.where(l, *self.leaves[:2]), np.where(r, *self.leaves[2:]))

    def column(self, feature: Callable[[int], Column]) -> Column:
        test = lambda s: feature(s[0]) < s[1]
        a, b, c, d = map(F.lit, self.leaves)
        return F.when(test(self.root), F.when(test(self.left), a).otherwise(b)).otherwise(F.when(test(self.right), c).otherwise(d))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    best, at = -1.0, (0, float("-inf"))
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], g[order].cumsum(), h[order].cumsum()
        cut = np.flatnonzero(v[1:] > v[:-1])
        if len(cut):
            gl, hl = gs[cut], hs[cut]
            gain = gl**2 / (hl + 1) + (gs[-1] - gl) ** 2 / (hs[-1] - hl + 1)
            k = int(gain.argmax())
            if gain[k] > best:
                best, at = float(gain[k]), (f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return at


@dataclass(frozen=True)
class Model:
    bias: float
    trees: tuple[Tree, ...]
    #: Of the calibration: probability = logistic(scale * margin + shift).
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((t.values(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.margin(x) + self.shift)))

    def column(self, feature: Callable[[int], Column]) -> Column:
        m = F.lit(self.bias)
        for t in self.trees:
            m = m + t.column(feature)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.scale) * m + F.lit(self.shift))))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, rate: float = 0.4) -> Model:
    p = np.clip(y.mean(), 0.01, 0.99)
    margin, trees, bias = np.full(len(y), np.log(p / (1 - p))), [], float(np.log(p / (1 - p)))
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        root = _split(x, g, h)
        below = x[:, root[0]] < root[1]
        sides = [_split(x[m], g[m], h[m]) if m.sum() > 1 else (0, float("inf")) for m in (below, ~below)]
        draft = Tree(root, *sides, (0.0, 1.0, 2.0, 3.0))
        leaf = draft.values(x).astype(int)
        t = Tree(root, *sides, tuple(float(rate * g[leaf == k].sum() / (h[leaf == k].sum() + 1)) for k in range(4)))
        trees.append(t)
        margin = margin + t.values(x)
    return Model(bias, tuple(trees))


def calibrated(m: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Platt's method: scale and shift by Newton steps on examples that the trees weren't fitted on."""
    z, target = m.margin(x), np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        q = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([((target - q) * z).sum(), (target - q).sum()]) - 1e-3 * np.array([a - 1, b])
        w = q * (1 - q)
        hess = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = a + step[0], b + step[1]
    return Model(m.bias, m.trees, float(a), float(b))


def threshold(m: Model, x: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability at and above which `precision` of the examples are positive."""
    p = m.probability(x)
    order = np.argsort(-p, kind="stable")
    share = y[order].cumsum() / np.arange(1, len(y) + 1)
    last = np.r_[p[order][1:] < p[order][:-1], True]
    good = np.flatnonzero((share >= precision) & last)
    return float(max(0.5, p[order][good[-1]])) if len(good) else 1.1
