"""Smoothing: segments share tasks and batches, and batches cut segments."""

from __future__ import annotations

import random

import pytest

from keelgrid.operators import behaviour


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_segments_are_whole_and_no_groups_of_their_own(spark, rows):
    r = random.Random(rows)
    names = ["stops", "dredging", "loaded_transit", None]
    data = []
    for s in [None, *(f"s{k}" for k in range(30))]:
        data += [(s, t, 1000 * (hash(s) % 97) + t, r.choice([1.0, 2.0, 6.0, None]), r.choice(names)) for t in range(r.randint(1, 9))]
    r.shuffle(data)
    df = spark.createDataFrame(data, "seg_id string, ts int, ping_id long, speed double, behaviour string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        out = behaviour.smoothed(df, 2)
        assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(x.seg_id, x.ts): (x.behaviour, x.behaviour_smooth, x.is_dredging) for x in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert out.columns == [*df.columns, "behaviour_smooth", "is_dredging"] and len(got) == len(data)
    for s in {x[0] for x in data}:
        own = sorted((x for x in data if x[0] == s), key=lambda x: x[1])
        want = behaviour.smooth([x[4] for x in own], [float("nan") if x[3] is None else x[3] for x in own], 2)
        assert [got[s, x[1]] for x in own] == [(x[4], w or "unknown", int((w or "unknown") == "dredging")) for x, w in zip(own, want, strict=True)]
