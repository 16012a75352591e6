"""Readers, and adapters that give the driver's tables the shape of vessel data.

`events` stand for pings, `orders` for yearly coverage, `customer` for ship specifications, `part` for seabed samples and
carbon, `nation` for provinces (rectangles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PING = T.StructType([T.StructField(n, t) for n, t in (("ping_id", T.LongType()), ("ssvid", T.LongType()), ("ts", T.TimestampType()), ("seg_id", T.StringType()), ("speed", T.DoubleType()), ("course", T.DoubleType()), ("lon", T.DoubleType()), ("lat", T.DoubleType()))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=header)


def read_many(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files of differing columns as one table, missing columns null."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def snake_case(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip().lower().replace(" ", "_").replace(".", "_") for c in df.columns))


def conform(df: DataFrame, schema: T.StructType, aliases: dict[str, str] | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """df with exactly the schema's columns: snake-case names, renamed by `aliases` (old to new, the first that is there
    wins), cast leniently (what can't be cast is null), absent columns from `defaults`. An absent column without a default is an error."""
    df, aliases, defaults = snake_case(df), aliases or {}, defaults or {}
    have = set(df.columns)
    columns = []
    for f in schema.fields:
        source = next((c for c in (f.name, *(a for a, n in aliases.items() if n == f.name)) if c in have), None)
        if source is None and f.name not in defaults:
            raise ValueError(f"column {f.name} is missing")
        value = F.lit(defaults.get(f.name)) if source is None else F.col(source)
        if source is not None and f.name in defaults:
            value = F.coalesce(value, F.lit(defaults[f.name]))
        columns.append((value.try_cast(f.dataType) if source is not None else value.cast(f.dataType)).alias(f.name))
    return df.select(*columns)


def pings(spark: SparkSession, sf_dir: str, by_vessel: bool = False) -> DataFrame:
    """by_vessel: events are dealt by vessel before anything is worked out from them, so places and speeds are not shuffled."""
    e, u = F.col("event_id"), F.col("user_id")
    events = table(spark, sf_dir, "events")
    return (events.repartition("user_id") if by_vessel else events).select(
        e.alias("ping_id"), u.alias("ssvid"), "ts", F.concat_ws("_", u.cast("string"), F.date_format("ts", "yyyyMMdd")).alias("seg_id"),
        F.least(F.col("value") / 12, F.lit(25.0)).alias("speed"), ((e * 37) % 360).cast("double").alias("course"),
        ((u * 37) % 300 - 150 + ((e * 13) % 200) / F.lit(1000.0)).alias("lon"), ((u * 17) % 120 - 60 + ((e * 7) % 200) / F.lit(1000.0)).alias("lat"),
    )


#: The same in SQL, as a CTE.
PINGS_SQL = """pings AS (SELECT event_id AS ping_id, user_id AS ssvid, ts, CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%d') AS seg_id,
  least(value / 12e0, 25e0) AS speed, CAST((event_id * 37) % 360 AS DOUBLE) AS course,
  (user_id * 37) % 300 - 150 + ((event_id * 13) % 200) / 1e3 AS lon, (user_id * 17) % 120 - 60 + ((event_id * 7) % 200) / 1e3 AS lat FROM events)"""


def ship_days(spark: SparkSession, sf_dir: str, ships: int = 11) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % ships).alias("ship"), F.to_date("o_orderdate").alias("day"))


SHIP_DAYS_SQL = "ship_days AS (SELECT o_custkey % 11 AS ship, CAST(o_orderdate AS DATE) AS day FROM orders)"


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("ssvid"), (8 + k % 9).cast("double").alias("service_speed_kn"), (2 + k % 4 + 0.6).alias("dredge_width_m"), (0.02 * (1 + k % 5)).alias("dredging_depth_m"))


SPECS_SQL = "specs AS (SELECT c_custkey AS ssvid, CAST(8 + c_custkey % 9 AS DOUBLE) AS service_speed_kn, 2 + c_custkey % 4 + 0.6e0 AS dredge_width_m, 0.02e0 * (1 + c_custkey % 5) AS dredging_depth_m FROM customer)"


def seabed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("seabed_id"), ((k * 37) % 300 - 150 + ((k * 29) % 200) / F.lit(1000.0)).alias("lon"), ((k * 17) % 120 - 60 + ((k * 11) % 200) / F.lit(1000.0)).alias("lat"),
        F.element_at(F.split("p_type", " "), 1).alias("lithology"), (F.col("p_size") / F.lit(100.0)).alias("pl_base"),
    )


SEABED_SQL = "seabed AS (SELECT p_partkey AS seabed_id, (p_partkey * 37) % 300 - 150 + ((p_partkey * 29) % 200) / 1e3 AS lon, (p_partkey * 17) % 120 - 60 + ((p_partkey * 11) % 200) / 1e3 AS lat, split_part(p_type, ' ', 1) AS lithology, p_size / 1e2 AS pl_base FROM part)"


def provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of 12 by 120 degrees that tile the longitudes."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.substring(F.col("n_name"), 1, 4).alias("province"), (k * 12 - 150).cast("double").alias("lon0"), (k * 12 - 138).cast("double").alias("lon1"), F.lit(-60.0).alias("lat0"), F.lit(61.0).alias("lat1"), (0.25 + k % 7).alias("k_fast"), F.when(k % 3 == 0, 1.5).when(k % 3 == 1, 0.5).otherwise(1.0).alias("fresh_fact"))


PROVINCES_SQL = "provinces AS (SELECT substr(n_name, 1, 4) AS province, CAST(n_nationkey * 12 - 150 AS DOUBLE) AS lon0, CAST(n_nationkey * 12 - 138 AS DOUBLE) AS lon1, -60e0 AS lat0, 61e0 AS lat1, 0.25e0 + n_nationkey % 7 AS k_fast, CASE n_nationkey % 3 WHEN 0 THEN 1.5e0 WHEN 1 THEN 0.5e0 ELSE 1e0 END AS fresh_fact FROM nation)"
