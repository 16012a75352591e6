"""Cells of pings and of ways: each table of pings is shuffled once at most, in sums."""

from datetime import datetime, timedelta

from keelgrid.operators import grid
from keelgrid.plans import vessel
from pyspark.sql import functions as F


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_periods_are_counted_from_marks(spark):
    rows = [(i % 7, datetime(1950, 1, 1) + timedelta(days=97 * i)) for i in range(1500)] + [(7, None), (7, None), (8, None), (8, datetime(2000, 1, 1)), (None, datetime(2000, 1, 1))]
    df = spark.createDataFrame(rows, "grid_id long, ts timestamp")
    for period, of in ((None, lambda t: t.year), (F.year("ts") - 2000, lambda t: t.year), (F.dayofyear("ts"), lambda t: t.timetuple().tm_yday)):
        want = {c: len({of(t) for k, t in rows if k == c and t}) for c in range(9)}
        got = grid.duration_years(df, period)
        assert {r.grid_id: r.years_trawled for r in got.collect()} == want and got.schema["years_trawled"].dataType.simpleString() == "bigint"
    assert "bit_or" in _plan(got)


def test_cells_of_either_side_are_completed(spark):
    cells = spark.createDataFrame([(1, 0.5), (2, None), (4, 0.25)], "grid_id long, f double")
    every = spark.createDataFrame([(2,), (3,), (3,), (4,)], "grid_id long")
    assert sorted(map(tuple, grid.completed(cells, every, ["f"]).collect())) == [(1, 0.5), (2, 0.0), (3, 0.0), (4, 0.25)]


def test_swept_cells_are_worked_out_once(spark, small):
    assert _plan(vessel.cells_completed(spark, small)).count("explode(") == _plan(vessel.fi_default(spark, small)).count("explode(")
