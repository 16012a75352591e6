"""Mixtures: Spark ML is given rows that are not kept as vectors, so it keeps its own, and the fit is its own."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler

from keelgrid.operators import behaviour


def test_vectors_are_kept_by_the_estimator_alone(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, float(x)) for i, x in enumerate(np.append(r.normal(2, 0.3, 300), r.normal(9, 1, 300)))]
    df = spark.createDataFrame(rows, "ping_id long, speed double")
    want = GaussianMixture(featuresCol="x", k=2, seed=42, maxIter=60, tol=1e-3).fit(VectorAssembler(inputCols=["speed"], outputCol="x").transform(df))
    levels, real = [], GaussianMixture.fit

    def fit(self, data, *a):
        levels.append((data.storageLevel.useMemory, data.storageLevel.useDisk))
        return real(self, data, *a)

    monkeypatch.setattr(GaussianMixture, "fit", fit)
    for most in (None, 10_000):
        got = behaviour.fit_mixture(df, ks=(2,), features=("speed",), rows=most)
        assert np.allclose(sorted(m[0] for m in got.means), sorted(float(g.mean[0]) for g in want.gaussians))
    assert levels == [(False, False)] * 2
