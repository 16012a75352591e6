from keelgrid.sources import adapters
from keelgrid.streaming.sessions import ping_stream, sessions
from pyspark.sql import functions as F


def test_stream_equals_batch(spark, small, tmp_path):
    pings = adapters.pings(spark, small).withColumn("ts", F.col("ts").cast("timestamp"))
    pings.repartition(3).write.parquet(f"{tmp_path}/in")
    last = pings.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 DAYS")).withColumn("ssvid", F.lit(-1).cast("long"))
    last.write.mode("append").parquet(f"{tmp_path}/in")
    stream = sessions(ping_stream(spark, f"{tmp_path}/in", pings.schema), "6 hours")
    q = stream.writeStream.format("memory").queryName("kg_sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda rows: sorted((r.ssvid, r.start, r.pings, round(r.top_speed, 9)) for r in rows if r.ssvid >= 0)
    assert key(spark.table("kg_sessions").collect()) == key(sessions(pings, "6 hours").collect())
