"""Isolation forests: one choice of rows a tree, and the scores of a plain version that draws the same numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from keelgrid.operators import iforest


def plain(x, trees, size, seed):
    random, n = np.random.default_rng(seed), len(x)
    size = min(size, n)
    most, depth = math.ceil(math.log2(max(size, 2))), np.zeros(n)
    for _ in range(trees):
        work = [(random.choice(n, size, replace=False), np.arange(n), 0)]
        while work:
            sample, rows, level = work.pop()
            low, high = (x[sample].min(axis=0), x[sample].max(axis=0)) if len(sample) else (0, 0)
            wide = np.flatnonzero(np.asarray(high) > np.asarray(low)) if len(sample) > 1 else []
            if level >= most or not len(wide) or not len(rows):
                depth[rows] += level + iforest._usual(len(sample))
                continue
            f = random.choice(wide)
            cut = random.uniform(low[f], high[f])
            a, b = x[sample, f] < cut, x[rows, f] < cut
            work += [(sample[a], rows[b], level + 1), (sample[~a], rows[~b], level + 1)]
    return 2 ** (-depth / trees / max(iforest._usual(size), 1e-9))


@pytest.mark.parametrize("n", [1, 2, 60, 256, 300])
def test_same_scores(n):
    r = np.random.default_rng(n)
    x = np.column_stack([r.normal(size=n), np.round(r.normal(size=n), 1), r.integers(0, 3, n) * 1.0, np.full(n, 2.0)])
    assert np.array_equal(iforest.anomaly(x, trees=5), plain(x, 5, 256, 42))


def test_nodes_make_no_choice_of_rows(monkeypatch):
    """What a node costs must not be what a vessel costs: a choice is ten times as long as a draw."""
    made, real = [], np.random.default_rng

    class Counted:
        def __init__(self, seed):
            self.own = real(seed)

        def choice(self, *a, **k):
            made.append(1)
            return self.own.choice(*a, **k)

        def __getattr__(self, name):
            return getattr(self.own, name)

    monkeypatch.setattr(np.random, "default_rng", Counted)
    iforest.anomaly(real(1).normal(size=(67, 4)), trees=5)
    assert len(made) == 5
