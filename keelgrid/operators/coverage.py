"""Yearly coverage of a fleet, and the best window of years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelgrid.functions.scalar import days_in_year

LEAST_YEARS = 5


def coverage(days: DataFrame) -> DataFrame:
    """(ship, day) to (ship, year, active_days, total_days, coverage). Days are made distinct by partial aggregates."""
    by = days.select("ship", "day").distinct().groupBy("ship", F.year("day").alias("year")).agg(F.count("*").alias("active_days"))
    return by.select("ship", "year", "active_days", days_in_year(F.col("year")).cast("long").alias("total_days")).withColumn("coverage", F.col("active_days") / F.col("total_days"))


def dense(cover: DataFrame) -> DataFrame:
    """Every ship with every year; missing coverage is 0. The grid is ships times years, both small dimensions."""
    cells = cover.select("ship").distinct().crossJoin(F.broadcast(cover.select("year").distinct()))
    return cells.join(cover.select("ship", "year", "coverage"), ["ship", "year"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def windows(cover: DataFrame, least: int = LEAST_YEARS) -> DataFrame:
    """All windows of `least` years or more with their scores: length * median * min^2 / (1 + cv), over the medians per year."""
    grid = dense(cover)
    years = grid.groupBy("year").agg(F.median("coverage").alias("mid"))
    ends = years.select(F.col("year").alias("start_year")).join(years.select(F.col("year").alias("end_year")), F.col("end_year") >= F.col("start_year") + least - 1)
    inside = ends.join(years, F.col("year").between(F.col("start_year"), F.col("end_year")))
    stats = inside.groupBy("start_year", "end_year").agg(F.count("*").alias("length"), F.median("mid").alias("median_coverage"), F.min("mid").alias("min_coverage"), F.stddev_samp("mid").alias("sd"))
    cv = F.when(F.col("median_coverage") == 0, F.lit(1e9)).otherwise(F.col("sd") / F.col("median_coverage"))
    score = F.col("length") * F.col("median_coverage") * F.col("min_coverage") * F.col("min_coverage") / (1 + F.col("cv_coverage"))
    fleet = ends.join(grid, F.col("year").between(F.col("start_year"), F.col("end_year"))).groupBy("start_year", "end_year").agg(F.count_distinct(F.when(F.col("coverage") > 0, F.col("ship"))).alias("active_ships"), F.avg("coverage").alias("total_coverage"))
    return stats.withColumn("cv_coverage", cv).withColumn("score", score).drop("sd").join(fleet, ["start_year", "end_year"])


def ranked(candidates: DataFrame, top: int = 20) -> DataFrame:
    """The best windows, with the margin to the next one (absolute, and as a share of the score)."""
    best = candidates.orderBy(F.desc("score"), "start_year", "end_year").limit(top)
    order = Window.orderBy(F.desc("score"), "start_year", "end_year")
    margin = F.col("score") - F.lead("score").over(order)
    return best.select(F.row_number().over(order).cast("long").alias("rank"), "start_year", "end_year", "score", margin.alias("margin"), (margin / F.col("score")).alias("margin_share"), F.sequence("start_year", "end_year").alias("years"))


def windows_by_ship(cover: DataFrame, least: int = LEAST_YEARS, beta: float = 1.0, delta: float = 1.0, weight: float = 1.0) -> DataFrame:
    """The older score: length^beta * median of the ships' medians * min^delta / (1 + weight * cv of the cells)."""
    years = cover.select("year").distinct()
    ends = years.select(F.col("year").alias("start_year")).join(years.select(F.col("year").alias("end_year")), F.col("end_year") >= F.col("start_year") + least - 1)
    cells = ends.join(cover, F.col("year").between(F.col("start_year"), F.col("end_year")))
    ships = cells.groupBy("start_year", "end_year", "ship").agg(F.median("coverage").alias("m")).groupBy("start_year", "end_year").agg(F.median("m").alias("c_med"), F.count("*").alias("ships"))
    all_ = cells.groupBy("start_year", "end_year").agg(F.min("coverage").alias("c_min"), (F.stddev_samp("coverage") / (F.avg("coverage") + F.lit(1e-9))).alias("cv"))
    score = F.pow(F.col("end_year") - F.col("start_year") + 1, F.lit(beta)) * F.col("c_med") * F.pow("c_min", F.lit(delta)) / (1 + F.lit(weight) * F.col("cv"))
    return ships.join(all_, ["start_year", "end_year"]).select("start_year", "end_year", "ships", "c_med", "c_min", "cv", score.alias("score"))


def active_ships(cover: DataFrame, start: int, end: int) -> DataFrame:
    return cover.where(F.col("year").between(start, end) & (F.col("coverage") > 0)).select("ship").distinct()


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys of `expected` that `found` lacks."""
    return expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def require_complete(rows: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """rows, or an error that names keys which the reference table lacks."""
    if lost := missing(rows, reference, key).take(10):
        raise ValueError(f"{key} without reference: {[r[0] for r in lost]}")
    return rows
