"""Filters for implausible pings, and the thresholds they use."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelgrid.functions.scalar import clamp
from keelgrid.operators.kinematics import kinematics, order

log = logging.getLogger(__name__)


def plausible_acceleration(df: DataFrame, most: float = 2.0 * 1.943844, column: str = "accel") -> DataFrame:
    return df.where(F.col(column).isNull() | (F.abs(column) <= most))


def slow_threshold(df: DataFrame, key: str = "ssvid", share: float = 0.05, low: float = 0.15, high: float = 0.8) -> DataFrame:
    """Per vessel the quantile of its positive speeds, and that cut to [low, high]."""
    by = df.where("speed > 0").groupBy(key).agg(F.percentile("speed", F.lit(share)).alias("q05"), F.count("*").alias("n_obs"))
    return by.withColumn("threshold", clamp(F.col("q05"), low, high))


def rolling(df: DataFrame, key: str = "seg_id") -> DataFrame:
    """Centred median over 5 pings and spread (1.4826 times the interquartile range); null where 5 are not there."""
    frame = order(key).rowsBetween(-2, 2)
    q = F.percentile("speed", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(frame)
    rows = df.withColumn("kg_n", F.count("speed").over(frame)).withColumn("kg_q", F.when(F.col("kg_n") == 5, q))
    return rows.withColumn("median5", F.col("kg_q")[1]).withColumn("spread5", F.lit(1.4826) * (F.col("kg_q")[2] - F.col("kg_q")[0])).drop("kg_n", "kg_q")


def speed_spikes(df: DataFrame, factor: float = 5.0, isolated: int = 2, key: str = "seg_id") -> DataFrame:
    """Adds speed_spike: far from the rolling median, unless more than `isolated` pings around it (itself included) are
    within the spread of it. Flags do not depend on each other."""
    near = F.collect_list("speed").over(order(key).rowsBetween(-isolated, isolated))
    rows = rolling(df, key).withColumn("kg_near", near)
    far = (F.col("spread5") > 0) & (F.abs(F.col("speed") - F.col("median5")) > factor * F.col("spread5"))
    alike = F.size(F.filter("kg_near", lambda x: F.abs(x - F.col("speed")) < F.col("spread5")))
    return rows.withColumn("speed_spike", F.coalesce(far & (alike <= isolated), F.lit(False))).drop("kg_near")


def cadence(df: DataFrame, key: str = "ssvid", scale: float = 1.0) -> DataFrame:
    """Per vessel: median and 95th percentile of dt_s, the share of long gaps, the adaptive gap threshold and the least
    run length. `scale` stretches all times, for data of another rhythm."""
    long_gap = (F.col("dt_s") >= 300 * scale).cast("int")
    by = df.where("dt_s is not null").groupBy(key).agg(F.percentile("dt_s", F.array(F.lit(0.5), F.lit(0.95))).alias("q"), F.count("*").alias("n_obs"), F.avg(long_gap).alias("long_share"))
    by = by.select(key, F.least(F.col("q")[0], F.lit(600.0 * scale)).alias("p50_s"), F.col("q")[1].alias("p95_s"), "n_obs", "long_share")
    usual = F.least(F.lit(900.0 * scale), F.greatest(F.lit(180.0 * scale), 3 * F.col("p50_s")))
    threshold = F.when(F.col("long_share") > 0.5, F.least(F.lit(1200.0 * scale), 5 * F.col("p50_s"))).otherwise(usual)
    least = F.least(F.lit(8.0), F.greatest(F.lit(3.0), F.ceil(F.lit(30.0 * scale) / F.col("p50_s")).cast("double")))
    return by.withColumn("threshold_s", threshold).withColumn("n_min", least)


def cadence_filtered(df: DataFrame, key: str = "ssvid", scale: float = 1.0) -> DataFrame:
    """Keeps pings whose gap is positive and below their vessel's threshold (or unknown), then computes the kinematics
    again; the segments stay whole."""
    stats = cadence(df, key, scale).select(key, "threshold_s", "n_min")
    kept = df.join(stats, key, "left").where(F.col("dt_s").isNull() | ((F.col("dt_s") > 0) & (F.col("dt_s") < F.col("threshold_s"))))
    return kinematics(kept.drop("dt_s", "turn_deg", "accel_ms2"))


def guard(name: str, before: int, after: int, most_share: float = 0.25, least_left: int = 20_000, fatal: bool = True) -> bool:
    """Whether a filter stayed within its budget; else an error, or a warning."""
    lost = (before - after) / before if before else 0.0
    if lost <= most_share and after >= least_left:
        return True
    text = f"{name}: {before - after} of {before} rows went ({lost:.1%}), {after} are left"
    if fatal:
        raise ValueError(text)
    log.warning(text)
    return False


def has_duplicates(df: DataFrame, keys: list[str]) -> bool:
    return bool(df.groupBy(*keys).count().where("count > 1").take(1))


def stratified(df: DataFrame, key: str, rows: int, ident: str = "ping_id") -> DataFrame:
    """About `rows` rows, each group by its share (at least one), in the order of an arithmetic hash of the id."""
    hashed = F.pmod(F.col(ident) * 7919 + 104729, F.lit(1_000_003))
    total = df.count()
    sizes = df.groupBy(key).agg(F.least(F.count("*"), F.ceil(F.lit(rows) * F.count("*") / F.lit(max(total, 1)))).alias("kg_quota"))
    number = F.row_number().over(Window.partitionBy(key).orderBy(hashed, ident))
    return df.withColumn("kg_number", number).join(sizes, key).where("kg_number <= kg_quota").drop("kg_number", "kg_quota")
