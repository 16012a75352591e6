"""Quantiles by narrowing are those of `percentile`, whatever the values."""

import math

import pytest
from keelgrid.operators import quantiles
from pyspark.sql import functions as F

PROBABILITIES = [0.0, 0.5, 0.95, 1.0]
def columns():
    return {
        "normal": F.randn(1),
        "heavy": F.pow(F.lit(10.0), F.randn(2) * 40),
        "tied": F.floor(F.rand(3) * 3).cast("double"),
        "one": F.lit(7.0),
        "mostly": F.when(F.rand(4) < 0.97, F.lit(0.0)).otherwise(F.rand(5)),
        "holes": F.when(F.rand(6) < 0.3, F.rand(7)),
        "none": F.lit(None).cast("double"),
        "odd": F.when(F.rand(8) < 0.02, F.lit(float("nan"))).when(F.rand(9) < 0.02, F.lit(float("inf"))).when(F.rand(10) < 0.02, F.lit(float("-inf"))).otherwise(F.rand(11)),
    }


@pytest.mark.parametrize("rows, collect, accuracy", [(20_000, 50, 200), (200_000, 20_000, 10_000), (3, 1, 100), (0, 10, 100)])
def test_quantiles_are_exact(spark, tmp_path, rows, collect, accuracy):
    spark.range(rows, numPartitions=4).select(*(c.alias(n) for n, c in columns().items())).write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    want = df.agg(*(F.percentile(n, F.array(*map(F.lit, PROBABILITIES))).alias(n) for n in columns())).first()
    got = quantiles.quantiles(df, {n: F.col(n) for n in columns()}, PROBABILITIES, collect, accuracy)
    for n in columns():
        assert all(a is b or a == b or math.isnan(a) and math.isnan(b) for a, b in zip(got[n], want[n] or [None] * len(PROBABILITIES), strict=True)), n
