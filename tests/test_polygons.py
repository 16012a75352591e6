"""The cell index against the even-odd rule over all edges, and distances against all arcs."""

import math
import random

import numpy as np
import pytest
from keelgrid.operators import polygons, provinces

SHAPES = "name string, rings array<array<struct<x double, y double>>>"


def star(rng, x, y, r, n):
    return [(x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def layer(seed=1):
    """Stars, overlapping, with holes; squares on round numbers; a name in two rows; rings without area."""
    rng = random.Random(seed)
    shapes = [(f"s{k}", [star(rng, x, y, r, n), star(rng, x, y, r / 5, 5)]) for k in range(12) for x, y, r, n in [(rng.uniform(-30, 30), rng.uniform(-20, 20), rng.uniform(0.2, 12), rng.choice([4, 9, 60, 400]))]]
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    shapes += [("box", [square(0, 0, 8), square(2, 2, 3)]), ("box2", [square(8, 0, 4)]), ("two", [square(-10, -10, 2)]), ("two", [square(-20, -10, 2.5)]), ("tiny", [square(5.25, 5.25, 0.001)])]
    return shapes + [("none", []), ("line", [[(0.0, 0.0), (5.0, 5.0)]]), ("null", None), ("flat", [[(1.0, 1.0), (4.0, 1.0), (1.0, 1.0)]])]


def frame(spark, shapes):
    return spark.createDataFrame([(n, rings and [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for n, rings in shapes], SHAPES)


def points_for(shapes, seed=2, n=1500):
    rng = random.Random(seed)
    out = [(rng.uniform(-45, 45), rng.uniform(-35, 35)) for _ in range(n)]
    out += [(float(rng.randrange(-12, 13)), float(rng.randrange(-12, 13))) for _ in range(300)]  # on edges and corners of the squares
    return out + [p for _, rings in shapes for ring in rings or [] for p in ring[:20]]


@pytest.mark.parametrize("cell", [1.0, 7.0, 0.3])
def test_points_are_where_even_odd_puts_them(spark, cell):
    shapes = layer()
    points = points_for(shapes)
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)] + [(-1, None, 1.0), (-2, float("nan"), 1.0), (-3, 1e300, 0.0)], "id long, lon double, lat double")
    got = {r.id: r.names for r in polygons.names_at(df, polygons.index_of(frame(spark, shapes), cell=cell), cell=cell).collect()}
    x, y = np.array(points).T
    by: dict[str, list] = {}
    for n, rings in shapes:
        by.setdefault(n, []).extend(np.array(r) for r in rings or [] if len(r) >= 3)
    inside = {n: provinces.even_odd(x, y, rings) for n, rings in by.items()}
    assert got == {k: sorted(n for n in by if inside[n][k]) for k in range(len(points))} | {-1: [], -2: [], -3: []}
    assert sum(len(v) > 1 for v in got.values()) > 20


def test_rows_are_kept_and_multiplied(spark):
    shapes = [("a", [[(0, 0), (4, 0), (4, 4), (0, 4)]]), ("b", [[(2, 2), (6, 2), (6, 6), (2, 6)]])]
    df = spark.createDataFrame([(1, 3.0, 3.0), (1, 3.0, 3.0), (2, 5.0, 5.0), (3, 9.0, 9.0)], "id int, lon double, lat double")
    got = sorted((r.id, r.province) for r in polygons.located(df, polygons.index_of(frame(spark, shapes))).collect() if r.province) + [r.id for r in polygons.located(df, polygons.index_of(frame(spark, shapes))).where("province IS NULL").collect()]
    assert got == [(1, "a"), (1, "a"), (1, "b"), (1, "b"), (2, "b"), 3]
    empty = polygons.index_of(frame(spark, []))
    assert empty.count() == 0 and [r.province for r in polygons.located(df, empty).collect()] == [None] * 4


def test_large_layers_take_the_index_and_agree(spark, monkeypatch):
    shapes = [(n, r) for n, r in layer(4) if n != "two"]
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points_for(shapes, 5, 300))], "id long, lon double, lat double")
    rng = random.Random(8)
    before = lambda r: (r.lon + rng.uniform(-3, 3), r.lat + rng.uniform(-3, 3)) if r.id % 5 else (None, None)
    steps = spark.createDataFrame([(r.id, r.lon, r.lat, *before(r)) for r in points.collect()], "id long, lon double, lat double, lon0 double, lat0 double")
    land = frame(spark, shapes)
    both = []
    for most in (provinces.MOST_VERTICES, 10):
        monkeypatch.setattr(provinces, "MOST_VERTICES", most)
        first = {r.id: r.name for r in provinces.in_polygons(points, land, name="name").collect()}
        flags = {r.id: (r.on_land, r.crosses_land) for r in provinces.land_flags(steps, land).collect()}
        both.append((first, flags))
    assert both[0] == both[1] and len(both[0][0]) == points.count() and {f for _, f in both[0][1].values()} == {False, True}


def vector(lon, lat):
    return np.array([math.cos(math.radians(lat)) * math.cos(math.radians(lon)), math.cos(math.radians(lat)) * math.sin(math.radians(lon)), math.sin(math.radians(lat))])


def arc(p, u, v):
    """The least angle to a thousand points of the arc, and to points between the two nearest again."""
    w = math.acos(max(-1.0, min(1.0, float(u @ v))))
    at = lambda t: u if w == 0 else (math.sin((1 - t) * w) * u + math.sin(t * w) * v) / math.sin(w)
    low, high = 0.0, 1.0
    for _ in range(4):
        ts = np.linspace(low, high, 60)
        d = [2 * math.asin(min(1.0, np.linalg.norm(at(t) - p) / 2)) for t in ts]
        k = int(np.argmin(d))
        low, high = ts[max(0, k - 1)], ts[min(59, k + 1)]
    return min(d)


@pytest.mark.parametrize("metres", [30_000.0, 400_000.0])
def test_distances_near_poles_and_the_antimeridian(spark, metres):
    rng = random.Random(6)
    rings = [[(179.0, 10.0), (-179.0, 10.5), (-178.5, 13.0), (178.5, 12.0)], [(0.0, 87.0), (90.0, 88.5), (180.0, 87.5), (-90.0, 89.0)], [(20.0, -89.5), (140.0, -89.0), (-100.0, -88.0)], [(5.0, 5.0), (5.0, 5.2), (45.0, 30.0)]]
    shapes = [(f"p{k}", [r]) for k, r in enumerate(rings)]
    places = [(rng.uniform(177, 183), rng.uniform(8, 15)) for _ in range(60)] + [(rng.uniform(-180, 180), rng.uniform(84, 90)) for _ in range(60)] + [(rng.uniform(-180, 180), rng.uniform(-90, -86)) for _ in range(40)] + [(rng.uniform(0, 50), rng.uniform(0, 36)) for _ in range(60)]
    places = [(x - 360 if x > 180 else x, y) for x, y in places] + [(0.0, 90.0), (77.0, -90.0), (5.0, 5.1), (-180.0, 10.25), (180.0, 10.25)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(places)] + [(-1, None, 5.0), (-2, 5.0, float("nan"))], "id long, lon double, lat double")
    got = {r.id: r.land_m for r in polygons.distance_to_edges(df, frame(spark, shapes), metres).collect()}
    arcs = [(vector(*a), vector(*b)) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)]
    near = 0
    for k, p in enumerate(places):
        want = min(arc(vector(*p), u, v) for u, v in arcs) * polygons.SPHERE_M
        if want <= metres:
            near += 1
            assert got[k] == pytest.approx(want, abs=20)
        else:
            assert got[k] is None
    assert got[-1] is None and got[-2] is None and 5 < near


def test_near_land(spark):
    shapes = [("isle", [[(10.0, 50.0), (11.0, 50.0), (11.0, 51.0), (10.0, 51.0)]])]
    df = spark.createDataFrame([(1, 10.5, 50.5), (2, 11.01, 50.5), (3, 11.2, 50.5), (4, None, 50.5), (1, 10.5, 50.5)], "id int, lon double, lat double")
    assert sorted((r.id, r.near_land) for r in polygons.near_land(df, frame(spark, shapes), 2000.0).collect()) == [(1, True), (1, True), (2, True), (3, False), (4, False)]


def test_cropping_keeps_the_even_odd_side(spark):
    """Stars with holes, a bow tie, a hole that touches its ring, a ring across and one round the box, one outside."""
    rng = random.Random(12)
    shapes = [(f"s{k}", [star(rng, rng.uniform(-6, 6), rng.uniform(-6, 6), 7, 9), star(rng, 0, 0, 2, 5)]) for k in range(6)]
    shapes += [("tie", [[(-4, -4), (4, 4), (4, -4), (-4, 4)]]), ("touch", [[(0, 0), (6, 0), (6, 6), (0, 6)], [(0, 0), (3, 1), (1, 3)]]), ("round", [[(-99, -99), (99, -99), (99, 99), (-99, 99)]]), ("out", [[(20, 20), (21, 20), (21, 21)]])]
    cut = polygons.cropped(frame(spark, shapes), -3.0, -2.5, 4.5, 3.25)
    got = {r.name: [np.array([(p.x, p.y) for p in ring]) for ring in r.rings] for r in cut.collect()}
    assert "out" not in got and set(got) <= {n for n, _ in shapes} and len(got["round"]) == 1
    assert sorted(map(tuple, got["round"][0].tolist())) == sorted([(-3.0, -2.5), (4.5, -2.5), (4.5, 3.25), (-3.0, 3.25)])
    x, y = np.array([(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(3000)]).T
    box = (x > -3) & (x < 4.5) & (y > -2.5) & (y < 3.25)
    for n, rings in shapes:
        before = provinces.even_odd(x, y, [np.array(r, float) for r in rings]) & box
        after = provinces.even_odd(x, y, got.get(n, []))
        assert (before == after).all(), n


def test_buffers_hold_what_is_within_the_distance(spark):
    shapes = [("l", [[(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)]]), ("hole", [[(10, 0), (16, 0), (16, 6), (10, 6)], [(12, 2), (14, 2), (14, 4), (12, 4)]]), ("none", None)]
    rng = random.Random(3)
    places = [(rng.uniform(-3, 19), rng.uniform(-3, 9)) for _ in range(1500)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "id long, lon double, lat double")
    pieces = polygons.buffered(frame(spark, shapes), 0.8)
    got = {r.id: r.names for r in polygons.in_buffer(df, pieces).collect()}
    for k, (x, y) in enumerate(places):
        for n, rings in shapes[:2]:
            inside = provinces.even_odd(np.array([x]), np.array([y]), [np.array(r, float) for r in rings])[0]
            away = 0.0 if inside else min(math.hypot(x - a - t * (c - a), y - b - t * (d - b)) for r in rings for (a, b), (c, d) in zip(r, r[1:] + r[:1], strict=True) for t in [max(0, min(1, ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)))])
            if away <= 0.8 or away > 0.8 / math.cos(math.pi / 16):
                assert (n in got[k]) == (away <= 0.8), (x, y, n, away)
