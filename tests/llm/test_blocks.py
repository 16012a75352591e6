"""Blocks of ids: ascending, of about one width, whatever the ids."""

import pytest
from keelgrid.llm import shared
from pyspark.sql import functions as F


@pytest.mark.parametrize("ids, most", [
    ("id", 3), ("abs(xxhash64(id)) % 4611686018427387904", 3),
    ("(id div 20000) * 10000000000 + id % 20000", 5),  # bursts far apart
    ("CASE WHEN id % 100 = 0 THEN id * 1000000007 ELSE id END", 5),  # dense ids with some far ones
])
def test_blocks_are_small_and_in_order(spark, tmp_path, ids, most, monkeypatch):
    monkeypatch.setattr(shared, "COARSE", 16)  # as a table many times as large would meet 1024
    spark.range(120_000, numPartitions=4).select(F.expr(ids).alias("doc_id")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = shared.with_blocks(df, "doc_id", F.lit(0), "b", 100)
    assert got.columns == ["doc_id", "b"]
    rows = got.groupBy("b").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("b").collect()
    assert sum(r.n for r in rows) == 120_000 and all(a.high < b.low for a, b in zip(rows, rows[1:], strict=False))
    assert max(r.n for r in rows) <= most * 100 + 120_000 * 8 // (16 * 16) and rows[0].b >= 0


def test_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(shared, "COARSE", 4)
    df = spark.range(5000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 1000).alias("doc_id"), "id")
    got = shared.with_blocks(df, "doc_id", (F.col("id") % 4096).cast("int"), "b", 10)
    assert got.where("doc_id IS NULL AND b >= 0").count() == 0 and got.where("doc_id IS NOT NULL AND b < 0").count() == 0
    assert got.groupBy("doc_id").agg(F.countDistinct("b").alias("n")).where("doc_id IS NOT NULL AND n > 1").count() == 0
