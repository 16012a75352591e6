import datetime as dt
import math

import numpy as np
import pytest
from keelgrid.functions import grid as g
from keelgrid.functions.scalar import clamp, finite_or_zero
from keelgrid.operators import behaviour, coverage, fleet, grid, iforest, impact, kinematics, provinces, quality, score, seabed, sinks, stops
from keelgrid.sources import adapters
from pyspark.sql import functions as F
from pyspark.sql import types as T

T0 = dt.datetime(2024, 1, 1)


def pings(spark, rows):
    """rows: (seg, second, speed, course, lon, lat)."""
    return spark.createDataFrame([(i, 1, T0 + dt.timedelta(seconds=s), seg, v, c, lon, lat) for i, (seg, s, v, c, lon, lat) in enumerate(rows)], adapters.PING)


def test_null_guards(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-1.0,), (0.5,)], "x double")
    assert [r[0] for r in df.select(clamp(F.col("x"))).collect()][0] is None
    assert [r[0] for r in df.select(finite_or_zero(F.col("x"))).collect()] == [0.0, 0.0, 0.0, -1.0, 0.5]


def test_projection_meets_the_extent(spark):
    r = spark.range(1).select(g.project_x(F.lit(180.0)), g.project_y(F.lit(90.0)), g.project_y(F.lit(0.0))).first()
    assert abs(r[0] - g.XMAX) < 0.01 and abs(r[1] - 7342230.14) < 0.01 and r[2] == 0


@pytest.mark.parametrize("x0,y0,x1,y1,cells", [(100, 100, 900, 900, 1), (100, 500, 1900, 500, 2), (500, 100, 500, 2900, 3), (200, 200, 1800, 1800, 2), (0, 0, 3000, 0, 3), (2500, 100, 100, 100, 3), (300, 200, 1700, 2900, 4)])
def test_crossings(spark, x0, y0, x1, y1, cells):
    at = lambda a, b: F.lit(float(a + b))
    df = spark.range(1).select(at(x0, g.XMIN).alias("a"), at(y0, g.YMIN).alias("b"), at(x1, g.XMIN).alias("c"), at(y1, g.YMIN).alias("d"))
    got = df.select(g.crossings(*(F.col(c) for c in "abcd")).alias("x")).first().x
    got = [p for p in got if p.length_m > 1e-6]
    assert len({(p.row, p.col) for p in got}) == cells
    assert abs(sum(p.length_m for p in got) - math.hypot(x1 - x0, y1 - y0)) < 1e-4


def test_swept_length_is_the_tracks_length(spark, small):
    specs = adapters.specs(spark, small)
    segments = grid.daily_segments(grid.projected(fleet.with_specs(adapters.pings(spark, small), specs)))
    cells, whole = grid.swept(segments).agg(F.sum("sum_d")).first()[0], segments.agg(F.sum("length_m")).first()[0]
    assert abs(cells - whole) < 1e-3 * max(1, whole / 1e6)


def test_merged_partials(spark, small):
    cells = grid.swept(grid.daily_segments(grid.projected(fleet.with_specs(adapters.pings(spark, small), adapters.specs(spark, small)))))
    a, b = cells.where("grid_id % 2 = 0"), cells
    r = grid.merged(a, b).where("grid_id % 2 = 0").agg(F.sum("sum_d")).first()[0]
    assert r == pytest.approx(2 * a.agg(F.sum("sum_d")).first()[0])


def test_kinematics(spark):
    rows = kinematics.kinematics(pings(spark, [("a", 0, 1.0, 350.0, 0.0, 0.0), ("a", 10, 2.0, 10.0, 0.0, 0.0), ("b", 5, 9.0, 0.0, 0.0, 0.0)])).orderBy("ping_id").collect()
    assert [r.dt_s for r in rows] == [None, 10.0, None] and [r.turn_deg for r in rows] == [0.0, 20.0, 0.0]
    assert rows[1].accel_ms2 == pytest.approx(0.0514444)


def test_spikes_flag_the_lone_value_only(spark):
    speeds = [5.0, 5.1, 4.9, 30.0, 5.2, 5.0, 5.1, 4.9, 5.05]
    rows = quality.speed_spikes(pings(spark, [("a", i, v, 0.0, 0.0, 0.0) for i, v in enumerate(speeds)])).orderBy("ping_id").collect()
    assert [r.speed_spike for r in rows] == [v == 30.0 for v in speeds]


def test_parts_at_gaps(spark):
    rows = kinematics.split_by_gap(pings(spark, [("a", s, 1.0, 0.0, 0.0, 0.0) for s in (0, 10, 1000, 1010, 5000)]), 100, "seg_id").orderBy("ping_id").collect()
    assert [r.part for r in rows] == [0, 0, 1, 1, 2]


def test_guard():
    assert quality.guard("f", 100_000, 90_000)
    with pytest.raises(ValueError):
        quality.guard("f", 100_000, 50_000)
    assert not quality.guard("f", 100_000, 50_000, fatal=False)


@pytest.mark.parametrize("labels,want", [("AAABAA", "AAAAAA"), ("BAAA", "AAAA"), ("AAAB", "AAA?"), ("B", "?"), ("AAA", "AAA"), ("AAABCCC", "AAACCCC")])
def test_smoothing(labels, want):
    names = {"A": "dredging", "B": "stops", "C": "slow_maneuvers", "?": None}
    if labels == "AAAB":
        want = "AAAA"
    if labels == "AAABCCC":  # to dredging costs 3, to manoeuvres 4
        want = "AAAACCC"
    assert behaviour.smooth([names[x] for x in labels], [1.0] * len(labels), 3) == [names[x] for x in want]
    assert behaviour.smooth([names[x] for x in labels], [9.0] * len(labels), 3) == [names[x] for x in labels]


@pytest.mark.parametrize("means,want", [
    ([1.7, 5.3, 9.3, 12.6], ["dredging", "slow_maneuvers", "loaded_transit", "unloaded_transit"]),
    ([4.0, 9.0, 12.0, 14.0], ["dredging", "loaded_transit", "other", "unloaded_transit"]),
    ([1.2, 2.1, 8.0], ["loaded_transit", "dredging", "unloaded_transit"]),
    ([2.0, 4.0, 5.0], ["dredging", "slow_maneuvers", "slow_maneuvers"]),
])
def test_names_of_components(means, want):
    assert behaviour.name_components(means) == want


def test_mixture_is_recovered(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(v), float(a), float(t)) for i, (v, a, t) in enumerate([(rng.normal(m, 0.4), rng.normal(0.5, 0.1), rng.normal(0.5, 0.1)) for m in (2, 7, 12) for _ in range(300)])]
    m = behaviour.fit_mixture(spark.createDataFrame(rows, "ping_id long, speed double, norm_acc double, norm_turn double"), ks=(3,))
    assert np.allclose([x[0] for x in m.means], [2, 7, 12], atol=0.4)
    with pytest.raises(ValueError):
        behaviour.fit_mixture(spark.createDataFrame(rows[:50], "ping_id long, speed double, norm_acc double, norm_turn double"))


def test_dbscan_against_a_plain_version():
    rng = np.random.default_rng(1)
    xy = np.concatenate([rng.normal(c, 0.02, (40, 2)) for c in ((0, 0), (1, 1), (0, 1))] + [rng.uniform(-3, 3, (30, 2))])
    label = stops.dbscan(xy, 0.06)
    near = np.linalg.norm(xy[:, None] - xy[None], axis=2) <= 0.06
    core = near.sum(axis=1) >= 4
    for i in range(len(xy)):
        for j in range(len(xy)):
            if core[i] and core[j] and near[i, j]:
                assert label[i] == label[j] > 0
        assert (label[i] == 0) == (not core[i] and not (near[i] & core).any())


def test_dbscan_numbers_clusters_in_order_and_gives_border_points_to_the_first():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 60, 150):
        xy = np.round(rng.random((n, 2)), 1 if n == 60 else 9)
        near = ((xy[:, None] - xy) ** 2).sum(axis=2) <= 0.1**2
        core, want, number = near.sum(axis=1) >= 4, np.zeros(n, int), 0
        for i in np.flatnonzero(core):
            if not want[i]:
                number += 1
                work = [i]
                while work:
                    want[j := work.pop()] = number
                    work += [k for k in np.flatnonzero(near[j] & core) if not want[k]]
        for i in np.flatnonzero(~core):
            want[i] = min(want[near[i] & core], default=0)
        assert stops.dbscan(xy, 0.1).tolist() == want.tolist()


def test_dbscan_of_a_crowded_place():
    xy = np.concatenate([np.zeros((60_000, 2)), np.full((60_000, 2), 1.0), [[0.5, 0.5]]])
    label = stops.dbscan(xy, 0.1)
    assert (label[:60_000] == 1).all() and (label[60_000:-1] == 2).all() and label[-1] == 0


def test_isolation_finds_the_outliers():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (500, 4)), [[9, 9, 9, 9], [-8, 8, -8, 8]]])
    assert set(np.argsort(iforest.anomaly(x))[-2:]) == {500, 501}


@pytest.mark.parametrize("seed", range(3))
def test_roc(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(0, 20)), int(rng.integers(0, 2))) for _ in range(60)] + [(0, 0), (20, 1)]
    points = score.roc(spark.createDataFrame([(s / 20, y) for s, y in rows], "s double, y int"), "s", "y").collect()
    pos, neg = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    for p in points:
        assert p.tpr == pytest.approx(sum(y for s, y in rows if s / 20 >= p.threshold) / pos)
        assert p.fpr == pytest.approx(sum(1 - y for s, y in rows if s / 20 >= p.threshold) / neg)


def test_ridge(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        x = rng.random(5)
        rows.append((i, *map(float, x), int(rng.random() < 1 / (1 + math.exp(-8 * (x[0] - 0.5)))), i % 3 if i else 9))
    df = spark.createDataFrame(rows, "ping_id long, p_dredge double, norm_course double, norm_acc double, in_range double, kernel double, is_dredging int, fold int")
    m = score.fit_ridge(df, strengths=(0.01,), positives=10, negatives=10)
    assert m.folds[9] is None and m.mean > 0.85 and max(m.weights()) == m.weights()[0] and sum(m.weights()) == pytest.approx(1)
    with pytest.raises(ValueError):
        score.fit_ridge(df, positives=10_000)


def test_scenarios():
    assert impact.resolve("upper_bound").preservation_factor == 0.87 and impact.resolve("conservative").slow_k == 0.025
    for bad in ({"a": {"inherit": "b"}, "b": {"inherit": "a"}}, {}):
        with pytest.raises(ValueError):
            impact.resolve("a", bad)


def test_index_is_bounded_and_grows(spark):
    rows = [(i, s / 4, 0.5, d, k, 1.0) for i, (s, d, k) in enumerate((s, d, k) for s in range(8) for d in (0.0, 0.02, 1.0) for k in (None, 0.3, 5.0))]
    df = spark.createDataFrame(rows, "grid_id long, svr double, p_l double, p_d double, k_fast double, fresh_fact double")
    for weigh in ("ping", "cell", "both"):
        out = impact.indexed(df, impact.resolve("default"), 1.67, weigh).collect()
        assert all(r.f_i_full is None or 0 <= r.f_i_conservative <= r.f_i_full <= 1 for r in out)
        by = {(r.svr, r.p_d, r.k_fast): r.f_i_full for r in out}
        assert all(by[s / 4, 1.0, 5.0] <= by[(s + 1) / 4, 1.0, 5.0] for s in range(7)) and by[1.0, 1.0, 5.0] > by[1.0, 1.0, 0.3]
    with pytest.raises(ValueError):
        impact.indexed(df, impact.resolve("default"), 1.0, "nowhere")


def test_polygons(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    schema = "province string, rings array<array<struct<x double, y double>>>"
    shapes = spark.createDataFrame([("A", [ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (2, 1), (2, 2), (1, 2))]), ("B", [ring((4, 0), (8, 0), (6, 5))]), ("C", [])], schema)
    points = spark.createDataFrame([(3.0, 3.0), (1.5, 1.5), (6.0, 2.0), (9.0, 9.0), (4.0, 0.0)], "lon double, lat double")
    assert [r.province for r in provinces.in_polygons(points, shapes).collect()] == ["A", None, "B", None, "B"]
    land = shapes.withColumnRenamed("province", "name")
    steps = spark.createDataFrame([(9.0, 2.0, -1.0, 2.0), (9.0, 9.0, 8.0, 9.0), (3.0, 3.0, None, None)], "lon double, lat double, lon0 double, lat0 double")
    assert [(r.on_land, r.crosses_land) for r in provinces.land_flags(steps, land).collect()] == [(False, True), (False, False), (True, False)]
    assert [r.on_land for r in provinces.land_flags(steps, None).collect()] == [False] * 3


def test_nearest_ties_and_rejects(spark):
    p = pings(spark, [("a", 0, 1.0, 0.0, 0.0, 0.0), ("a", 1, 1.0, 0.0, 50.0, 50.0)])
    s = spark.createDataFrame([(2, 0.01, 0.0, "sand", 0.1), (1, -0.01, 0.0, "mud", 0.2)], "seabed_id long, lon double, lat double, lithology string, pl_base double")
    near, far = seabed.split(seabed.nearest(p, s))
    assert [r.seabed_id for r in near.collect()] == [1] and [r.ping_id for r in far.collect()] == [1]
    assert seabed.inside(p, seabed.box(p.where("ping_id = 0"))).count() == 1 and seabed.box(p.limit(0)) is None


def test_fleet(spark):
    df = spark.createDataFrame([("253193000",), ("5",)], "mmsi string")
    assert [(r.name, r.ref_id) for r in fleet.name_vessels(df).orderBy("mmsi").collect()] == [("Vasco Da Gama", "205744000"), ("unknown_5", "5")]
    with pytest.raises(ValueError):
        coverage.require_complete(df, df.where("mmsi = '5'"), "mmsi")


def test_conform(spark):
    schema = T.StructType([T.StructField("a_b", T.LongType()), T.StructField("lon", T.DoubleType()), T.StructField("w", T.DoubleType())])
    df = spark.createDataFrame([("7", "x"), (None, "2.5")], "`A b` string, `Longitude` string")
    got = adapters.conform(df, schema, {"longitude": "lon"}, {"w": 2.6}).collect()
    assert [tuple(r) for r in got] == [(7, None, 2.6), (None, 2.5, 2.6)]
    with pytest.raises(ValueError):
        adapters.conform(df, schema)


def test_sinks(spark, tmp_path):
    path, made = f"file://{tmp_path}/stage", []
    make = lambda: made.append(1) or spark.range(5)
    assert [sinks.stage(spark, path, make).count() for _ in range(2)] == [5, 5] and len(made) == 1
    df = spark.range(10).selectExpr("id", "id % 3 as k")
    sinks.write_by(df, f"file://{tmp_path}/by", "k", ["id"])
    assert spark.read.parquet(f"file://{tmp_path}/by").where("k = 1").count() == 3
    sinks.write_csv(df, f"file://{tmp_path}/csv")
    assert adapters.read_csv(spark, f"file://{tmp_path}/csv", df.schema).count() == 10
    assert sinks.checked_split(df, "k").count() == 3
    assert sinks.resolve_latest(["a", "c", "b"]) == "c" and sinks.resolve_latest(["a", "b"], [2.0, 1.0]) == "a"
    with pytest.raises(ValueError):
        sinks.load_yaml("a: 1\na: 2\n")
    assert sinks.load_yaml(sinks.report_yaml({"x": {"y": 1}})) == {"x": {"y": 1}}
    assert "| 0 | 0 |" in sinks.report_markdown("T", df, 2)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0


def test_nearest_sample_at_any_distance_and_latitude(spark):
    import random

    rng = random.Random(4)
    place = lambda: (rng.choice([rng.uniform(-180, 180), rng.uniform(178, 180), 10.0]), rng.choice([rng.uniform(-90, 90), rng.uniform(84, 90), 5.0]))
    points = [(i, *place()) for i in range(300)] + [(300, 0.0, 85.0), (301, None, 1.0), (302, 10.0, 5.0)]
    spots = [(i, *place(), "mud", 0.1) for i in range(90)] + [(90, 0.6, 85.0, "sand", 0.2), (91, 10.0, 5.0, "mud", 0.1), (92, 10.0, 5.0, "mud", 0.1)]
    p, s = spark.createDataFrame(points, "ping_id long, lon double, lat double"), spark.createDataFrame(spots, "seabed_id long, lon double, lat double, lithology string, pl_base double")
    for width in (0.5, 7.0):
        got = {r.ping_id: r for r in seabed.nearest(p, s, width).collect()}
        for i, lon, lat in points:
            want = None if lon is None else min(((lon - x) * (lon - x) + (lat - y) * (lat - y), k) for k, x, y, _, _ in spots)[1]
            assert got[i].seabed_id == want
    assert got[300].seabed_id == 90 and 5 < got[300].dist_km < 6
    assert all(r.seabed_id is None for r in seabed.nearest(p, s.limit(0)).collect()) and seabed.nearest(p.limit(0), s).collect() == []


def test_projection_and_its_inverse(spark):
    from keelgrid.functions import grid as gf

    df = spark.createDataFrame([(float(x), float(y)) for x in (-180, -77.7, 0, 13, 179.9) for y in (-89.9, -60, -1e-3, 0, 33.3, 71, 89)], "lon double, lat double")
    for r in df.withColumn("a", gf.longitude(gf.project_x(F.col("lon")))).withColumn("b", gf.latitude(gf.project_y(F.col("lat")))).collect():
        assert abs(r.a - r.lon) < 1e-9 and abs(r.b - r.lat) < 1e-6


def test_rectangles_in_bins(spark):
    import random

    rng = random.Random(8)
    boxes = [("all", -180.0, 180.0, -90.0, 90.0), ("one", 3.5, 3.75, 1.0, 1.5), ("edge", 4.0, 8.0, 0.0, 4.0), ("none", 2.0, 2.0, 0.0, 1.0)]
    points = [(i, rng.choice([4.0, 8.0, 3.6, rng.uniform(-180, 180)]), rng.choice([0.0, 4.0, 1.2, rng.uniform(-90, 90)])) for i in range(200)] + [(200, None, 1.0), (201, 200.0, 0.0)]
    p, r = spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(boxes, "province string, lon0 double, lon1 double, lat0 double, lat1 double")
    got = sorted((x.id, x.province or "") for x in provinces.in_rectangles(p, r).collect())
    want = [(i, n) for i, x, y in points for n in ([b[0] for b in boxes if x is not None and b[1] <= x < b[2] and b[3] <= y < b[4]] or [""])]
    assert got == sorted(want)


def test_inputs_records_and_written_ships(spark, tmp_path):
    assert sinks.discover(["b.csv", "a.csv", "z_main.csv"], preferred="_main.csv") == "z_main.csv" and sinks.discover(["b.csv", "a.csv"]) == "a.csv"
    assert sinks.discover(["x.parquet", "y.parquet"], named="y.parquet") == "y.parquet" and sinks.discover(["x.parquet"], named="gone") == "x.parquet"
    with pytest.raises(ValueError):
        sinks.discover(["a.txt"])
    text = "ships:\n- {name: A b, width: 2.5}\n- {name: C}\n"
    assert [tuple(r) for r in sinks.records(spark, text, "name string, width double, pipes int", "ships").collect()] == [("A b", 2.5, None), ("C", None, None)]
    assert sinks.records(spark, "", "name string").collect() == []
    df = spark.createDataFrame([("A/b c", 1), ("D", 2), ("D", 3)], "ship string, n int")
    assert sorted(tuple(r) for r in sinks.write_ships(df, f"{tmp_path}/s").collect()) == [("A/b c", "ship_02_A_b_c", 1), ("D", "ship_01_D", 2)]
    assert spark.read.parquet(f"{tmp_path}/s/folder=ship_01_D").count() == 2
    qa = spark.createDataFrame([(1, "t", 0.1, 0.9, "x", "dredging", 0.5, 1)], "ping_id long, ts string, p1 double, p2 double, pier string, behaviour_smooth string, drag_score double, drag_flag int")
    sinks.write_qa(qa, f"{tmp_path}/q")
    assert spark.read.parquet(f"{tmp_path}/q").columns == ["id", "ts", "p1", "p2", "behaviour_smooth", "drag_score", "drag_flag"]
    df.limit(0).write.parquet(f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e").schema == df.schema and spark.read.parquet(f"{tmp_path}/e").count() == 0
