"""What the swept area shuffles: narrow pings by vessel, then a row for each segment, then about one for each cell."""

import numpy as np
import pytest
from keelgrid.operators import grid
from keelgrid.plans import vessel
from pyspark.sql import functions as F


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def _ways(spark):
    """Vessels one over the other: each sweeps the same 40 by 40 km, across borders of tiles, and some ways leave the grid or stand still."""
    random = np.random.default_rng(4)
    ends = random.uniform(44_000, 84_000, (3000, 4)) + np.tile([grid.g.XMIN, grid.g.YMIN], 2)
    rows = [(float(i % 5), None if i % 11 == 0 else 0.1, *map(float, e)) for i, e in enumerate(ends)]
    rows += [(2.0, 0.1, grid.g.XMIN - 3500.0, grid.g.YMIN + 10.0, grid.g.XMIN + 900.0, grid.g.YMIN + 10.0), (2.0, 0.1, 0.0, 0.0, 0.0, 0.0), (None, 0.1, 0.0, 0.0, 250_000.0, 130_000.0)]
    df = spark.createDataFrame(rows, "width_m double, depth_m double, x0 double, y0 double, x1 double, y1 double").repartition(16)
    return df.withColumn("length_m", F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0"))))


def test_sums_do_not_depend_on_tiles(spark, monkeypatch):
    rounded = lambda: sorted(tuple(None if x is None else round(x, 6) for x in r) for r in grid.swept(_ways(spark)).collect())
    got = rounded()
    monkeypatch.setattr(grid, "TILE_M", 1e9)
    assert rounded() == got and len({r[0] for r in got}) == len(got) > 1600
    assert sum(r[3] for r in got) == pytest.approx(_ways(spark).agg(F.sum("length_m")).first()[0] - 3500)


def test_a_cell_has_sums_of_few_tasks(spark):
    """Sixteen tasks read the ways, each of which touches all cells: but for ways over borders of tiles a cell's sums are one row."""
    df = grid.swept(_ways(spark))
    cells, plan = len(df.collect()), df._jdf.queryExecution().executedPlan()
    sums = [n for n in _nodes(plan) if n.nodeName() == "HashAggregate"]
    assert sums[-1].metrics().apply("numOutputRows").value() < 4.5 * cells


@pytest.mark.parametrize("name", ["fallback_stats", "fi_default", "map_bins", "fi_conservative", "fi_reduced", "fi_upper_bound"])
def test_no_places_are_dealt_by_vessel(spark, small, name):
    """A place is worked out from an event behind the shuffle: it carries what it must only."""
    plan = vessel.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan()
    dealt = [n for n in _nodes(plan) if n.nodeName() == "RepartitionByExpression"]
    assert [sorted(n.output().apply(i).name() for i in range(n.output().size())) for n in dealt] == [["event_id", "ts", "user_id"]]


def test_crossings_are_worked_out_once(spark, small):
    """Neither a filter nor the rows before the shuffle of segments have them."""
    assert _plan(vessel.map_bins(spark, small)).count("array_distinct(") == 1


def _nodes(node) -> list:
    """A plan's nodes, the last next to the tables."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return _nodes(node.executedPlan())
    if node.nodeName().endswith("QueryStage"):
        return _nodes(node.plan())
    below = node.children()
    return [node, *(x for i in range(below.size()) for x in _nodes(below.apply(i)))]
