"""Whitening against a dense decomposition of the exactly centred rows."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from quotaline.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, id string, x int, n string, whitened int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "i", 1, "n", 2) for i, v in rows], SCHEMA)


def whole(v):
    return tuple(math.floor(64 * c) + 1_000_000 for c in v)


def check(got, rows, components=16):
    """The rows of one length against numpy; returns the number of components."""
    usable = [(i, whole(v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in usable})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    a = np.array([[float(Fraction(n * x[k] - sums[k], n)) for k in range(d)] for x in fit])
    _, s, v = np.linalg.svd(a, full_matrices=False)
    e, v = s**2 / n, v.T
    k = min(components, int((s > 1e-12 * s[0]).sum()))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
    assert sum(len(x) for x in by.values()) == len(usable) * k
    sign = None
    for i, x in usable:
        deviation = sum((n * x[j] - sums[j]) ** 2 for j in range(d))
        own = sorted(by[i, deviation if deviation < 1 << 63 else None], key=lambda r: r.component)[:k]
        assert [r.component for r in own] == list(range(1, k + 1))
        want = np.array([float(Fraction(n * x[j] - sums[j], n)) for j in range(d)]) @ v[:, :k] / np.sqrt(e[:k])
        have = np.array([r.whitened for r in own])
        if sign is None or (np.abs(sign) < 1e-3).any():
            sign = np.where(np.abs(want) > 1e-3, np.sign(want * have), 0 if sign is None else sign)
        use = sign != 0
        assert np.allclose(have[use], (sign * want)[use], rtol=1e-6, atol=1e-6)
        assert np.allclose([r.explained for r in own], e[:k] / e.sum(), rtol=1e-6)
        assert all(r.n == n and r.identity_error < 1e-6 for r in own)
    return k


def result(spark, rows):
    return whitening.by_component(whitening.whiten(table(spark, rows))).collect()


@pytest.mark.parametrize("d", [3, 24])
def test_against_a_dense_decomposition(spark, d):
    rng = np.random.default_rng(d)
    spread = 1.5 ** -np.arange(d) * 40
    rows = [(i, (rng.normal(size=d) * spread + 7).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)]  # a hot vector counts once
    rows += [(0, rows[3][1]), (None, rows[4][1]), (2000, None), (2001, []), (2002, [None] * d), (2003, [float("nan")] * d), (2004, [float("-inf")] * d)]
    assert check(result(spark, rows), rows) == min(16, d)


def test_ill_conditioned_rows(spark):
    """Directions ten million times weaker than the first, on top of the offset."""
    rng = np.random.default_rng(1)
    mixing, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    rows = [(i, (rng.normal(size=6) * [1e6, 1e5, 1e3, 10, 1, 0.5] @ mixing).tolist()) for i in range(300)]
    assert check(result(spark, rows), rows) == 6


def test_constant_and_dependent_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [a, b, 2 * a, 5.0, -a]) for i, (a, b) in enumerate(rng.integers(-50, 50, (200, 2)).astype(float).tolist())]
    assert check(result(spark, rows), rows) == 2


def test_lengths_are_spaces_of_their_own(spark):
    rng = np.random.default_rng(3)
    short = [(i, rng.normal(size=2).tolist()) for i in range(60)]
    long_ = [(100 + i, rng.normal(size=5).tolist()) for i in range(60)]
    got = result(spark, short + long_)
    assert check([r for r in got if r.vec_id < 100], short) == 2
    assert check([r for r in got if r.vec_id >= 100], long_) == 5


def test_exact_deviation_beyond_a_long(spark):
    big = float(1 << 40)
    got = whitening.whiten(table(spark, [(1, [big, 0.0]), (2, [-big, 0.0]), (3, [0.0, 1e300]), (4, [1.0, -1e300])])).collect()
    assert len(got) == 4 and all(r.deviation is None for r in got)


def test_tables_without_components(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None), (2, [])]) == []
    assert result(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    (row,) = whitening.whiten(table(spark, [(1, [1.0, 2.0])])).collect()
    assert (row.n, row.deviation, row.whitened) == (1, 0, [])


def test_identity_is_measured(spark):
    rng = np.random.default_rng(4)
    rows = table(spark, [(i, rng.normal(size=8).tolist()) for i in range(500)])
    got = whitening.whiten(rows, components=4).collect()
    w = np.array([r.whitened for r in got])
    assert got[0].identity_error >= 0 and np.abs(w.T @ w / len(w) - np.eye(4)).max() < 1e-9
