"""Vessel identity: ids, names, aliases, specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelgrid.functions.scalar import sanitise

#: Identity number, vessel, identity number in force.
VESSELS = (
    ("209469000", "Fairway", "209469000"),
    ("210138000", "Queen Of The Netherlands", "210138000"),
    ("245508000", "Ham 318", "245508000"),
    ("246351000", "Vox Maxima", "246351000"),
    ("253193000", "Vasco Da Gama", "205744000"),
    ("205744000", "Vasco Da Gama", "205744000"),
    ("253373000", "Cristobal Colon", "253373000"),
    ("253403000", "Leiv Eiriksson", "253403000"),
    ("253422000", "Charles Darwin", "253422000"),
    ("253688000", "Congo River", "253688000"),
    ("533180137", "Inai Kenanga", "533180137"),
)
#: Spelling, name.
ALIASES = (
    ("Ham 318 Sleephopperzuiger", "Ham 318"),
    ("HAM318", "Ham 318"),
    ("Queen of the netherlands", "Queen Of The Netherlands"),
    ("Vasco de Gama", "Vasco Da Gama"),
    ("LEIV EIRIKSSONN", "Leiv Eiriksson"),
    ("INAI KENANGA", "Inai Kenanga"),
    ("Goryo 6 HO", "Goryo 6 Ho"),
    ("Fair Way", "Fairway"),
    ("VOX maxima", "Vox Maxima"),
)


def values(spark: SparkSession, rows: tuple[tuple[str, ...], ...], names: str) -> DataFrame:
    """A small table written down in code."""
    quoted = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t({names})")


def name_vessels(df: DataFrame, key: str = "mmsi") -> DataFrame:
    """Adds name (unknown_<id> where the id is not in the table) and ref_id."""
    dim = values(df.sparkSession, VESSELS, "mmsi_key, vessel, ref")
    met = df.join(F.broadcast(dim), F.col(key) == F.col("mmsi_key"), "left")
    return met.select(*(f"`{c}`" for c in df.columns), F.coalesce("vessel", F.concat(F.lit("unknown_"), F.col(key))).alias("name"), F.coalesce("ref", F.col(key)).alias("ref_id"))


def normalise_names(df: DataFrame, column: str = "name") -> DataFrame:
    dim = values(df.sparkSession, ALIASES, "spelling, canonical")
    return df.join(F.broadcast(dim), F.col(column) == F.col("spelling"), "left").withColumn(column, F.coalesce("canonical", F.col(column))).drop("spelling", "canonical")


def remap(df: DataFrame, column: str, old: object, new: object) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == F.lit(old), F.lit(new)).otherwise(F.col(column)))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in an order that must decide."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("kg_row", F.row_number().over(w)).where("kg_row = 1").drop("kg_row")


def with_specs(pings: DataFrame, specs: DataFrame, key: str = "ssvid") -> DataFrame:
    """Pings with the first specification of their vessel. Spark broadcasts it where its size allows."""
    return pings.join(first_per_key(specs, [key], ["service_speed_kn", "dredge_width_m", "dredging_depth_m"]), key, "left")


def speed_capped(df: DataFrame, factor: float = 1.15) -> DataFrame:
    """Drops pings faster than the service speed allows; a missing specification keeps them."""
    return df.where(F.col("service_speed_kn").isNull() | F.col("speed").isNull() | (F.col("speed") <= F.lit(factor) * F.col("service_speed_kn")))


def core(df: DataFrame, ships: DataFrame, start: int, end: int, key: str = "ship") -> DataFrame:
    return df.where(F.year("day").between(start, end)).join(ships, key, "left_semi")


def split_plan(df: DataFrame, key: str) -> DataFrame:
    """Groups by size: rows, ordinal (largest first), and a file-safe folder name."""
    counts = df.groupBy(key).agg(F.count("*").alias("rows"))
    ordinal = F.row_number().over(Window.orderBy(F.desc("rows"), key))
    return counts.withColumn("ordinal", ordinal.cast("long")).withColumn("folder", F.concat(F.lit("vessel_"), F.format_string("%02d", "ordinal"), F.lit("_"), sanitise(F.col(key).cast("string"))))
