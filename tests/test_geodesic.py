"""Published lengths, and the swept area by true lengths against the map's own."""

import math
import random

import pytest
from keelgrid.functions import geodesic
from keelgrid.functions import grid as g
from keelgrid.operators import grid
from pyspark.sql import functions as F


def dms(d, m, s):
    return (abs(d) + m / 60 + s / 3600) * (-1 if d < 0 else 1)


#: Latitude, longitude, latitude, longitude, metres, ellipsoid (fixed values from the publications).
WGS, GRS, BESSEL, INTERNATIONAL = (6378137.0, 1 / 298.257223563), (6378137.0, 1 / 298.257222101), (6377397.155, 1 / 299.1528128), (6378388.0, 1 / 297.0)
LINES = [
    (dms(-37, 57, 3.72030), dms(144, 25, 29.52440), dms(-37, 39, 10.15610), dms(143, 55, 35.38390), 54972.271, GRS),
    (40.6, -73.8, 51.6, -0.5, 5551759.400, WGS),
    (0.0, 0.0, 0.0, 1.0, 111319.4908, WGS),
    (0.0, 20.0, 90.0, 77.0, 10001965.7293, WGS),
    (dms(55, 45, 0), 0.0, dms(-33, 26, 0), dms(108, 13, 0), 14110526.170, BESSEL),
    (dms(37, 19, 54.95367), 0.0, dms(26, 7, 42.83946), dms(41, 28, 35.50729), 4085966.703, INTERNATIONAL),
    (dms(35, 16, 11.24862), 0.0, dms(67, 22, 14.77638), dms(137, 47, 28.31435), 8084823.839, INTERNATIONAL),
    (10.0, 179.5, 10.0, -179.5, None, WGS),
]


def test_published_lines(spark):
    for ellipsoid in (WGS, GRS, BESSEL, INTERNATIONAL):
        lines = [x for x in LINES if x[5] == ellipsoid]
        df = spark.createDataFrame([(k, *map(float, x[:4])) for k, x in enumerate(lines)], "k int, a double, b double, c double, d double")
        for r in df.select("k", geodesic.geodesic_m(*map(F.col, "abcd"), *ellipsoid).alias("m"), geodesic.geodesic_m(*map(F.col, "cdab"), *ellipsoid).alias("back")).collect():
            assert r.m == pytest.approx(r.back, abs=1e-6)
            assert lines[r.k][4] is None or r.m == pytest.approx(lines[r.k][4], abs=1e-3)


def test_edges_of_the_definition(spark):
    df = spark.createDataFrame([(1, 5.0, 5.0, 5.0, 5.0), (2, None, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 0.5, 179.9), (4, 10.0, 179.5, 10.0, -179.5), (5, 10.0, 20.0, 10.0, 21.0), (6, 0.0, 3.0, 0.0, 3.0)], "k int, a double, b double, c double, d double")
    got = {r.k: r.m for r in df.select("k", geodesic.geodesic_m(*map(F.col, "abcd")).alias("m")).collect()}
    assert got[1] == 0 and got[6] == 0 and got[2] is None and got[3] is None and got[4] == pytest.approx(got[5], abs=1e-6)


def test_true_lengths_in_the_swept_area(spark):
    """Along a parallel the map's length is off by cos 30 over cos of the latitude, nearly; true lengths of a way's shares sum to the way's."""
    rng = random.Random(4)
    ways = [(lat, lon, lat + rng.uniform(-0.02, 0.02) * (k % 3 > 0), lon + 0.03) for k in range(5) for lat, lon in [(rng.uniform(-65, 65), rng.uniform(-170, 170))]]
    df = spark.createDataFrame([(k, *w) for k, w in enumerate(ways)], "k int, a double, b double, c double, d double")
    seg = df.select("k", "a", "b", "c", "d", F.lit(2.0).alias("width_m"), F.lit(0.05).alias("depth_m"), g.project_x(F.col("b")).alias("x0"), g.project_y(F.col("a")).alias("y0"), g.project_x(F.col("d")).alias("x1"), g.project_y(F.col("c")).alias("y1"))
    seg = seg.withColumn("length_m", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    whole = {r.k: r.m for r in seg.select("k", geodesic.geodesic_m(*map(F.col, "abcd")).alias("m")).collect()}
    for k, (a, _, c, _) in enumerate(ways):
        one = seg.where(F.col("k") == k)
        planar, true = (grid.swept(one, true_length=t).agg(F.sum("sum_d"), F.sum("sum_dw")).first() for t in (False, True))
        assert planar[0] == pytest.approx(one.first().length_m, rel=1e-9)
        assert true[0] == pytest.approx(whole[k], rel=1e-5) and true[1] == pytest.approx(2 * true[0])
        if a == c:
            assert true[0] / planar[0] == pytest.approx(math.cos(math.radians(a)) / math.cos(math.radians(30)), rel=3e-3)
