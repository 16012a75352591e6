"""Hard negatives against comparing all anchors with all rows."""

import math
import random

import numpy as np
import pytest
from keelgrid.llm import negatives


def plain(rows, every=50, positives=5, count=3, low=50, high=95):
    best = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        best[i] = min(best.get(i, (label, v)), (label, v))
    best = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in best.items()}
    best = {i: x for i, x in best.items() if sum(y * y for y in x[1]) <= 2**62}
    out = []
    for a, (label, v) in best.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, (other, w) in best.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:count]
            out += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, rank int, `kg.row` string").repartition(3)
    out = negatives.hard_negatives(df, lambda i: i % 50 == 0, **more)
    assert out.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    return sorted(tuple(r) for r in out.collect())


def f32(x):
    return float(np.float32(x))


def table(seed, n=600, labels=4, d=5, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [f32(rng.gauss(0.3, spread)) for _ in range(d)], rng.randrange(labels)) for i in range(-100, n)]
    copy = rows[7][1]
    rows += [(n + k, copy, k % labels) for k in range(120)]  # ties by the hundred
    return rows


@pytest.mark.parametrize("more", [{}, {"tree_bytes": 2000, "block_bytes": 400, "leaf": 3}])
def test_negatives_are_those_of_comparing_all(spark, more):
    rows = table(1)
    rows += rows[:40] + [(None, [1.0] * 5, 1), (5000, None, 1), (5050, [1.0, None], 1), (5100, [1.0, float("nan")], 1), (5150, [float("inf")], 1), (5200, [1.0] * 5, None)]
    rows += [(50, [f32(9.0)] * 5, 3), (5250, [], 1), (5300, [1.0, 2.0], 2), (5350, [1.0] * 9, 2)]
    want = plain(rows)
    assert len(want) > 100 and mined(spark, rows, **more) == want


def test_large_numbers_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [f32(rng.choice([-1, 1]) * rng.random() * 2**21) for _ in range(6)], i % 3) for i in range(400)] + [(10**6, [f32(2**40)], 1)]
    assert mined(spark, rows) == plain(rows) != []


def test_tables_without_rows_anchors_or_negatives(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(0, [1.0], 1), (50, [1.0], 1)]) == []
    with pytest.raises(TypeError):
        negatives.hard_negatives(spark.createDataFrame([("a", [1.0], 1)], "vec_id string, embedding array<float>, label int"), lambda i: i % 50 == 0)


def test_bounds_spare_comparisons():
    """Clusters far apart: most of a tree is pruned, and nothing that counts."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3000, (40, 8))
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 20, (4000, 8))).astype(np.int64)
    ids, labels = np.arange(4000), rng.integers(0, 2, 4000)
    tree = negatives.Tree.unpacked(negatives.Tree(ids, labels, x, 16).packed())
    anchors = np.arange(0, 4000, 100)
    everything = np.full((40, 1), negatives._NONE + 1), np.full((40, 1), np.iinfo(np.int64).max)
    search = negatives.Search(anchors, labels[anchors], x[anchors], *everything, 5, True)
    search.through(tree)
    assert search.compared < 0.3 * 40 * 4000
    scores = x[anchors] @ x.T
    for k, a in enumerate(anchors):
        want = sorted((-scores[k, i], i) for i in range(4000) if i != a and labels[i] == labels[a])[:5]
        assert [(-s, i) for s, i in zip(search.score[k, 0], search.found[k, 0], strict=True)] == want
