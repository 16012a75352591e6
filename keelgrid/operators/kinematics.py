"""What a ping is relative to the pings before and after it. Windows are cut by segment, which spreads a large vessel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelgrid.functions.scalar import KNOT_MS, haversine_nm, is_false_or_null, seconds, turn


def order(key: str = "seg_id"):
    return Window.partitionBy(key).orderBy("ts", "ping_id")


def kinematics(df: DataFrame, key: str = "seg_id") -> DataFrame:
    """dt_s (null on a segment's first ping), turn_deg and accel_ms2 (0 there)."""
    w = order(key)
    dt = seconds(F.col("ts")) - seconds(F.lag("ts").over(w))
    accel = (F.col("speed") - F.lag("speed").over(w)) * F.lit(KNOT_MS) / F.greatest(F.col("dt_s"), F.lit(1.0))
    change = F.coalesce(turn(F.lag("course").over(w), F.col("course")), F.lit(0.0))
    return df.withColumn("dt_s", dt).withColumn("turn_deg", change).withColumn("accel_ms2", F.coalesce(accel, F.lit(0.0)))


def steps(df: DataFrame, key: str = "seg_id") -> DataFrame:
    """Great-circle distances in nautical miles: to the ping before, to the one after, and between those two."""
    w = order(key)
    lat, lon = F.col("lat"), F.col("lon")
    before, after = (F.lag(lat).over(w), F.lag(lon).over(w)), (F.lead(lat).over(w), F.lead(lon).over(w))
    return df.withColumns({"d_prev_nm": haversine_nm(*before, lat, lon), "d_next_nm": haversine_nm(lat, lon, *after), "d_bridge_nm": haversine_nm(*before, *after)})


def jump(dt: Column, service: Column, factor: float = 1.5, default_kn: float = 30.0, far_nm: float = 100.0, within_s: float = 3600.0) -> Column:
    """Whether the way from the ping before is too fast, or too far for its time. False where that can't be told."""
    speed = F.when(dt > 0, F.col("d_prev_nm") / dt * 3600)
    fast = speed > F.coalesce(service * factor, F.lit(default_kn))
    return F.coalesce(fast, F.lit(False)) | F.coalesce((F.col("d_prev_nm") > far_nm) & (dt <= within_s), F.lit(False))


def spike(least_nm: float = 1.0, bridge_nm: float = 0.3) -> Column:
    """Whether a ping lies off a way that goes on without it."""
    return F.coalesce((F.col("d_prev_nm") > least_nm) & (F.col("d_next_nm") > least_nm) & (F.col("d_bridge_nm") < bridge_nm), F.lit(False))


def unflagged(df: DataFrame, flag: str) -> DataFrame:
    return df.where(is_false_or_null(F.col(flag)))


def stop_flag(speed: Column, dt: Column, slow_kn: float = 1.0, pause_s: float = 300.0) -> Column:
    return F.coalesce((speed < slow_kn) | (dt > pause_s), F.lit(False))


def split_by_gap(df: DataFrame, gap_s: float, key: str = "ssvid") -> DataFrame:
    """Adds part, which grows by one after every gap longer than gap_s."""
    w = order(key)
    gap = seconds(F.col("ts")) - seconds(F.lag("ts").over(w)) > gap_s
    return df.withColumn("part", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(w))
