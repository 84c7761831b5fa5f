"""A generalised additive model with pairwise interactions: a lookup table per feature and per chosen pair.

Features are cut into quantile bins. The tables are learned by cyclic boosting: feature after feature, round after
round, a shallow tree over the feature's bins is fitted to the gradient and a small part of it is added to the
feature's table. Then the pairs of features whose two-dimensional trees help most get tables, boosted the same way.
A row's score is the sum of the table entries of its bins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The gain of the best cut of ordered bins, and its place."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0.0, 0
    gain = a**2 / (b + ridge) + (g.sum() - a) ** 2 / (h.sum() - b + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """The values of a tree of up to ``leaves`` leaves over ordered bins, grown where the gain is highest."""
    ranges, cuts = [(0, len(g))], []
    while len(ranges) < leaves:
        cuts = [(*_split(g[a:b], h[a:b], ridge), i) for i, (a, b) in enumerate(ranges)]
        gain, at, i = max(cuts)
        if gain <= 1e-9:
            break
        a, b = ranges.pop(i)
        ranges += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in ranges:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), ridge)
    return out


def tree2(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The gain and values of the best tree over two features' bins: one cut of the first, one of the second a side."""
    best = (0.0, np.zeros_like(g))
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for at in range(1, len(a)):
            values, gain = np.zeros_like(a), -a.sum() ** 2 / (b.sum() + ridge)
            for rows in (slice(0, at), slice(at, None)):
                x, y = a[rows].sum(axis=0), b[rows].sum(axis=0)
                more, cut = _split(x, y, ridge)
                gain += more + x.sum() ** 2 / (y.sum() + ridge)
                for cols in (slice(0, cut), slice(cut, None)):
                    if cut or cols.start:
                        values[rows, cols] = _leaf(x[cols].sum(), y[cols].sum(), ridge)
                    elif not cut:
                        values[rows] = _leaf(x.sum(), y.sum(), ridge)
            if gain > best[0]:
                best = (gain, values.T if turn else values)
    return best


@dataclass
class Gam:
    """Learned tables; ``score`` is the probability of label 1."""

    edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[b[:, f]]
        for (i, j), table in self.pairs.items():
            total += table[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return sigmoid(total)


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 32, rounds: int = 250, rate: float = 0.08, n_pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 60, ridge: float = 3.0) -> Gam:
    """Learn from rows ``x`` with labels 0 or 1. Without both labels, the score is the share of label 1 (0.5 without rows)."""
    cuts = np.linspace(0, 1, n_bins + 1)[1:-1]
    model = Gam([np.unique(np.quantile(x[:, f], cuts)) if len(x) else np.zeros(0) for f in range(x.shape[1])])
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(share / (1 - share)))
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(n) for n in sizes]
    model.coarse = [np.arange(n) * min(pair_bins, n) // n for n in sizes]
    if not 0 < y.sum() < len(y):
        return model
    b, total = model.bins(x), np.full(len(y), model.base)

    def gradient(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(total)
        return np.bincount(at, weights=y - p, minlength=n), np.bincount(at, weights=p * (1 - p), minlength=n)

    for _ in range(rounds):
        for f, n in enumerate(sizes):
            if n > 1:
                step = rate * tree(*gradient(b[:, f], n), ridge)
                model.tables[f] += step
                total += step[b[:, f]]
    places = {}
    gains = {}
    for i, j in combinations(range(len(sizes)), 2):
        n, m = model.coarse[i][-1] + 1, model.coarse[j][-1] + 1
        if n > 1 and m > 1:
            places[i, j] = (model.coarse[i][b[:, i]] * m + model.coarse[j][b[:, j]], (n, m))
            g, h = gradient(places[i, j][0], n * m)
            gains[i, j] = tree2(g.reshape(n, m), h.reshape(n, m), ridge)[0]
    chosen = sorted(gains, key=gains.get, reverse=True)[:n_pairs]
    model.pairs = {p: np.zeros(places[p][1]) for p in chosen}
    for _ in range(pair_rounds):
        for p in chosen:
            at, shape = places[p]
            g, h = gradient(at, shape[0] * shape[1])
            step = rate * tree2(g.reshape(shape), h.reshape(shape), ridge)[1]
            model.pairs[p] += step
            total += step.ravel()[at]
    return model
