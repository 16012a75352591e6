"""The flagged pings of the chain: the score is worked out step by step and once a ping, whatever is odd about the pings."""

import re
from datetime import datetime

import duckdb
import pytest
from keelgrid.functions.scalar import clamp, finite_or_zero
from keelgrid.operators import behaviour, grid, quantiles
from keelgrid.plans import chain
from pyspark.sql import functions as F


def _nodes(node) -> list:
    below = node.children()
    return [node, *(x for i in range(below.size()) for x in _nodes(below.apply(i)))]


def test_no_filter_holds_the_score(spark, small):
    """A filter that holds its steps works each out as often as it is used."""
    plan = chain.flagged_pings(spark, small, False)._jdf.queryExecution().optimizedPlan()
    filters = [n for n in _nodes(plan) if n.nodeName() == "Filter"]
    assert any("kg_score" in n.condition().sql() for n in filters) and not any("exp(" in n.condition().sql().lower() for n in filters)


def test_pings_are_dealt_once_by_vessel(spark, small):
    plan = chain.flagged_pings(spark, small, False)._jdf.queryExecution().optimizedPlan()
    dealt = [n for n in _nodes(plan) if n.nodeName() == "RepartitionByExpression"]
    assert [sorted(n.output().apply(i).name() for i in range(n.output().size())) for n in dealt] == [["event_id", "ts", "user_id", "value"]]


def test_java_compiles_the_score(spark, small):
    """Methods over 8000 bytes are only ever interpreted."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        query = chain.flagged_pings(spark, small, False)._jdf.queryExecution()
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", spark.sparkContext._jvm.PythonSQLUtils.explainString(query, "codegen"))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) <= 8000


def test_inputs_of_the_score_are_finite(spark):
    odd = [None, float("nan"), float("inf"), -float("inf"), -3.0, 0.0, 0.4, 2.0, 7.0]
    df = spark.createDataFrame([(a, b, c) for a in odd for b in odd for c in odd], "speed double, accel_ms2 double, turn_deg double")
    old = {
        "norm_acc": finite_or_zero(clamp(F.abs("accel_ms2") / F.lit(0.5))),
        "norm_turn": finite_or_zero(clamp(F.col("turn_deg") / F.lit(4.0))),
        "norm_course": finite_or_zero(clamp(1 - F.col("turn_deg") / F.lit(4.0))),
        "kernel": finite_or_zero(F.exp(-F.pow(F.col("speed") - 2.25, 2) / 2)),
    }
    wrong = F.lit(False)
    for c, x in old.items():
        wrong = wrong | ~F.col(c).eqNullSafe(x)
    assert behaviour.normed(df, 0.5, 4.0).where(wrong).count() == 0


def test_lability_and_years_are_those_worked_out_apart(spark):
    rows = [(i % 9 if i % 10 else None, datetime(2024, 1 + i % 12, 1 + i % 28) if i % 7 else None, [None, float("nan"), 0.25, 0.5][i % 4], [None, 3.0, 30.0][i % 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "grid_id long, ts timestamp, pl_eff double, dist_km double")
    period = F.dayofyear("ts")
    want = {r.grid_id: (r.n_with_pl, r.pl_sum, r.p_l, r.years_trawled) for r in grid.lability(df).join(grid.duration_years(df, period), "grid_id").collect()}
    got = {r.grid_id: (r.n_with_pl, r.pl_sum, r.p_l, r.years_trawled) for r in grid.lability_and_years(df, period).collect()}
    assert len(got) == 9 and got == want


def test_ranks_of_one_range_share_a_sketch(spark, monkeypatch):
    asked, real = [], quantiles.F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: asked.append(1) or real(*a))
    df = spark.range(50_000).select(F.pmod(F.col("id") * 7919, F.lit(50_021)).cast("double").alias("x"))
    want = df.select(F.percentile("x", F.array(F.lit(0.3), F.lit(0.95)))).first()[0]
    assert quantiles.quantiles(df, {"x": F.col("x")}, [0.3, 0.95], collect=2000)["x"] == pytest.approx(want, rel=1e-15) and len(asked) == 1


@pytest.mark.parametrize("repeated", [False, True])
def test_odd_pings(spark, small, tmp_path, repeated):
    """Missing vessels, ids, times and values, and ids of several rows, give the SQL's cells."""
    own = f"""SELECT * REPLACE (
      CASE WHEN event_id % 41 = 0 THEN NULL WHEN {str(repeated).lower()} AND event_id % 5 = 0 THEN event_id + 1 ELSE event_id END AS event_id,
      CASE WHEN event_id % 53 = 0 THEN NULL ELSE user_id % 7 END AS user_id,
      CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 59 = 0 THEN 'nan'::DOUBLE ELSE value END AS value) FROM '{small}/events.parquet'"""
    duck = duckdb.connect()
    duck.execute(f"COPY ({own}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for t in ("customer", "part", "nation"):
        duck.execute(f"COPY (SELECT * FROM '{small}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    for t in ("events", "customer", "part", "nation"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = chain.flagged_cri(spark, str(tmp_path))
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    rel = duck.sql(chain.ORACLES["flagged_cri"])
    want = sorted(repr(tuple(r[rel.columns.index(c)] for c in columns)) for r in rel.fetchall())
    assert len(got) > 100 and got == want
