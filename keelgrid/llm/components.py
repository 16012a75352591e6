"""Connected components by alternating large-star and small-star steps, every step a written table.

The steps end when a step changes nothing; their number grows with the logarithm of the longest chain. An empty table
gives an empty table. Of the written tables the last stays, until the session ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelgrid.llm.shared import discard, shared_folder, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. The minimum of a node's neighbours is a partial aggregate; the join back is a sort-merge join whose large
    partitions Spark splits, so that the centre of a large star is no hot task."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    both = edges.unionByName(back) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("kg_least")).select(F.col("u").alias("kg_u"), F.least("kg_least", "u").alias("kg_m"))
    met = both.join(least, F.col("u") == F.col("kg_u"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("kg_m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("kg_m").alias("v")).unionByName(least.select(F.col("kg_u").alias("u"), F.col("kg_m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (u, v), long, without nulls: (u, v) for each node but the smallest of its component, v that smallest."""
    spark, folder, step, before = edges.sparkSession, shared_folder(edges.sparkSession, "components"), 0, None
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{folder}/{step}")
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            return edges
        before, step = now, step + 1
        edges = written(_star(_star(edges, True), False), f"{folder}/{step}")
        discard(spark, f"{folder}/{step - 1}")
