"""Vessel sessions on a stream: pings of one vessel without a longer gap than given. Works on batches too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ping_stream(spark, path: str, schema) -> DataFrame:
    """Parquet files that arrive in a folder, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def sessions(pings: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Per vessel and session: start, end, pings, mean and top speed. Pings later than `late` behind the newest are left out
    of a stream; state is one row an open session."""
    timed = pings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    by = timed.groupBy("ssvid", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("pings"), F.avg("speed").alias("mean_speed"), F.max("speed").alias("top_speed"))
    return by.select("ssvid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "pings", "mean_speed", "top_speed")
