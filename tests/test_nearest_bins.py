import numpy as np
import pytest
from keelgrid.operators import seabed


def test_tight_clusters_are_cut_and_copies_count_once(spark):
    """The first halvings part nothing of a cluster of a fifth of a degree; places, not samples, fill a bin."""
    some = np.random.default_rng(1).uniform(0.05, 0.2, (3000, 2))
    rows = spark.createDataFrame([(float(x), float(y)) for x, y in some], "lon double, lat double")
    bins, width = seabed._occupied(rows, 0.5)
    assert width < 0.25 and len(bins) * seabed.BIN_SAMPLES >= 3000
    copies = spark.range(5000).selectExpr("0.125D as lon", "0.125D as lat")
    assert seabed._occupied(copies, 0.5)[1] == 0.5


def test_bins_within_reach():
    random = np.random.default_rng(2)
    bins = np.unique(random.integers(-300, 300, (400, 2)), axis=0)
    for a, b in random.integers(-900, 900, (200, 2)):
        apart = np.abs(bins - (a, b))
        least, most = np.maximum(apart - 1, 0), apart + 1
        assert (seabed._within(bins, a, b) == bins[(least * least).sum(axis=1) <= (most * most).sum(axis=1).min()]).all()


def test_nearest_by_brute_force_with_copies_ties_and_odd_rows(spark):
    random = np.random.default_rng(3)
    samples = [(i, float(random.integers(0, 40)) / 128 + 90 * (i % 2), float(random.integers(0, 40)) / 128, "xy"[i % 2], i / 4) for i in range(2000)]
    samples += [(-1, None, 0.0, "z", 0.0), (-2, float("nan"), 0.0, "z", 0.0)]
    pings = [(i, float(random.integers(-20, 60)) / 256 + 45 * (i % 3), float(random.integers(-20, 60)) / 256) for i in range(300)]
    pings += [(7, 90.0, 0.1), (7, 0.0, 0.0), (None, 0.1, 0.1), (1000, None, 0.1), (1001, 0.1, float("nan"))]
    got = seabed.nearest(spark.createDataFrame(pings, "ping_id long, lon double, lat double"), spark.createDataFrame(samples, "seabed_id long, lon double, lat double, lithology string, pl_base double")).collect()
    best = {}
    for i, lon, lat in pings[:-3]:
        best[i] = min([((lon - s[1]) * (lon - s[1]) + (lat - s[2]) * (lat - s[2]), s[0], s[3]) for s in samples[:-2]] + ([best[i]] if i in best else []))
    assert len(got) == len(pings)
    for r in got:
        assert (r.seabed_id, r.lithology) == (best[r.ping_id][1:] if r.ping_id in best else (None, None))


_SAMPLE = "seabed_id long, lon double, lat double, lithology string, pl_base double"


@pytest.mark.parametrize("most", [100_000, 10])
def test_pings_that_stand_once_by_brute_force(spark, monkeypatch, most):
    """Few places are searched as pings are read, more in joins; both say the same, with nulls and ties."""
    monkeypatch.setattr(seabed, "MOST_PLACES", most)
    monkeypatch.setattr(seabed, "AT_ONCE", 50)
    random = np.random.default_rng(5)
    samples = [(i, float(random.integers(0, 64)) / 64 + 120 * (i % 2), float(random.integers(-8, 8)) / 8, None if i % 5 else "x", i / 4) for i in range(500)]
    pings = [(i, float(random.integers(-64, 64)) / 64 + 60 * (i % 3), float(random.integers(-16, 16)) / 8) for i in range(-200, 200)]
    odd = [(None, 0.5, 0.5), (None, 0.5, 0.5), (900, None, 0.5), (901, 0.5, float("nan")), (902, float("inf"), 0.5)]
    got = seabed.nearest(spark.createDataFrame(pings + odd, "ping_id long, lon double, lat double"), spark.createDataFrame(samples, _SAMPLE)).collect()
    best = {i: min(((x - s[1]) * (x - s[1]) + (y - s[2]) * (y - s[2]), s[0], s[3], s[4]) for s in samples)[1:] for i, x, y in pings}
    assert len(got) == len(pings) + len(odd)
    for r in got:
        assert (r.seabed_id, r.lithology, r.pl_base) == best.get(r.ping_id, (None, None, None))


def test_no_ping_is_shuffled_where_places_are_few(spark):
    pings = spark.range(1000).selectExpr("id as ping_id", "id % 40 / 8D as lon", "id % 25 / 8D as lat")
    samples = spark.range(500).selectExpr("id as seabed_id", "id % 16 / 4D as lon", "id % 9 / 4D as lat", "'x' as lithology", "1D as pl_base")
    df = seabed.nearest(pings, samples)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_repeated_ids(spark):
    ids = lambda *x: seabed.repeated_ids(spark.createDataFrame([(i,) for i in x], "ping_id long"))
    assert not ids(*range(-130, 130), None, None, 2**63 - 1, -(2**63)) and not ids()
    assert all(ids(*range(-130, 130), i) for i in (-130, -1, 0, 63, 64)) and ids(2**63 - 1, 2**63 - 1)


def test_lithology_is_not_joined_back_to_the_pings(spark, small):
    from keelgrid.plans import vessel

    df = vessel.pings_with_lithology(spark, small)
    assert df.columns == ["ping_id", "ssvid", "lithology", "pl_base"] and df.count() == spark.read.parquet(f"{small}/events.parquet").count()
    assert df._jdf.queryExecution().executedPlan().toString().count("events.parquet") <= 1 and "SortMergeJoin" not in df._jdf.queryExecution().toString()
