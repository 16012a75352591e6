"""Pings and tracks on the 1 km grid: cells, daily lines, swept area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelgrid.functions import grid as g
from keelgrid.functions.geodesic import geodesic_m

#: Width of the tiles by which segments are dealt, in metres.
CELL_AREA_M2, TILE_M = g.CELL * g.CELL, 64 * g.CELL
_ENDS = ("x0", "y0", "x1", "y1")


def projected(df: DataFrame) -> DataFrame:
    return df.withColumn("x", g.project_x(F.col("lon"))).withColumn("y", g.project_y(F.col("lat")))


def snapped(df: DataFrame) -> DataFrame:
    """Adds col, row, grid_id from x, y; grid_id is null outside the grid."""
    return df.withColumn("col", g.column_of(F.col("x"))).withColumn("row", g.row_of(F.col("y"))).withColumn("grid_id", g.grid_id(F.col("row"), F.col("col")))


def decoded(df: DataFrame) -> DataFrame:
    """Adds col, row and the centre x, y of grid_id."""
    out = df.withColumn("col", g.column_in(F.col("grid_id"))).withColumn("row", g.row_in(F.col("grid_id")))
    return out.withColumn("x", g.centre_x(F.col("col"))).withColumn("y", g.centre_y(F.col("row")))


def located(cells: DataFrame) -> DataFrame:
    """Adds lon and lat of the centres of grid_id."""
    return decoded(cells).withColumn("lon", g.longitude(F.col("x"))).withColumn("lat", g.latitude(F.col("y"))).drop("x", "y")


def binned(df: DataFrame, value: str, size_deg: float = 1.0) -> DataFrame:
    """Sums of a value by bins of lon and lat, for maps: lon_bin and lat_bin (lower edges), cells, total, mean."""
    edge = lambda c: (F.floor(F.col(c) / F.lit(size_deg)) * F.lit(size_deg)).cast("double").alias(f"{c}_bin")
    return df.groupBy(edge("lon"), edge("lat")).agg(F.count("*").alias("cells"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def completed(cells: DataFrame, every: DataFrame, columns: list[str]) -> DataFrame:
    """Every grid_id of the cells and of `every`, with the cells' columns, 0 where a cell has none. The world's grid is not made."""
    return every.select("grid_id").distinct().join(cells.select("grid_id", *columns), "grid_id", "full").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


def _length() -> Column:
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return F.sqrt(dx * dx + dy * dy)


def daily_segments(df: DataFrame, most_m: float | None = None) -> DataFrame:
    """From projected pings: the straight ways between one vessel's consecutive pings of a day, each with the width and depth of the
    day's first ping. Longer ways than most_m are left out."""
    day = F.date_format("ts", "yyyyMMdd")
    line = Window.partitionBy("ssvid", "day").orderBy("ts", "ping_id")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.withColumn("day", day).select(
        "ssvid", "day", F.first("dredge_width_m").over(whole).alias("width_m"), F.first("dredging_depth_m").over(whole).alias("depth_m"),
        F.lag("x").over(line).alias("x0"), F.lag("y").over(line).alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"),
    ).where("x0 is not null")
    rows = rows.withColumn("length_m", _length())
    return rows if most_m is None else rows.where(F.col("length_m") <= most_m)


def daily_tracks(segments: DataFrame) -> DataFrame:
    return segments.groupBy("ssvid", "day").agg(F.count("*").alias("segments"), F.sum("length_m").alias("length_m"), F.first("width_m").alias("width_m"))


def swept(segments: DataFrame, true_length: bool = False) -> DataFrame:
    """Per cell the length, and length times width and times width times depth. The cells of a segment come from closed
    formulas: no spatial join, no overlaps. Segments are first dealt by the tile in which they begin, so a cell's sums come from few
    tasks: at most a row for each segment is shuffled, and then about one for each cell, however many cells a segment crosses. How
    the tiles are dealt changes no sum; Spark splits crowded ones. Lengths are the map's, which is equal-area and so
    stretches ways; with true_length they are those of the geodesics between the points where the segment meets the cell's borders."""
    tile = (F.floor((F.col("x0") - F.lit(g.XMIN)) / TILE_M).alias("kg_tx"), F.floor((F.col("y0") - F.lit(g.YMIN)) / TILE_M).alias("kg_ty"))
    ways = segments.where("length_m > 0").select(*tile, "width_m", "depth_m", *_ENDS).hint("rebalance", "kg_tx", "kg_ty").drop("kg_tx", "kg_ty")
    ways = ways.withColumns({"length_m": _length(), "kg_all": g.crossings(*map(F.col, _ENDS))})
    # A plain explode would first ask whether each segment has cells at all, and so work them out several times; each has.
    cells, length = (_geodesics(ways), F.col("kg_m")) if true_length else (ways.select("width_m", "depth_m", F.explode_outer("kg_all").alias("c")), F.col("c.length_m"))
    cells = cells.select(g.grid_id(F.col("c.row"), F.col("c.col")).alias("grid_id"), length.alias("d"), "width_m", "depth_m").where("grid_id is not null")
    return cells.groupBy("grid_id").agg(F.sum(F.col("d") * F.col("width_m")).alias("sum_dw"), F.sum(F.col("d") * F.col("width_m") * F.col("depth_m")).alias("sum_dw_pd"), F.sum("d").alias("sum_d"))


def _geodesics(ways: DataFrame) -> DataFrame:
    """The ways' shares one by one, each with the geodesic length (kg_m) between its ends."""
    parts = ways.select("*", F.posexplode("kg_all").alias("kg_k", "c"))
    before = F.aggregate(F.slice("kg_all", F.lit(1), F.col("kg_k")), F.lit(0.0), lambda s, x: s + x["length_m"])
    parts = parts.withColumn("kg_from", before / F.col("length_m")).drop("kg_all").withColumn("kg_to", F.col("kg_from") + F.col("c.length_m") / F.col("length_m"))
    at = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * F.col(t)
    for n, t in (("p", "kg_from"), ("q", "kg_to")):
        parts = parts.withColumns({f"kg_{n}lon": g.longitude(at("x0", "x1", t)), f"kg_{n}lat": g.latitude(at("y0", "y1", t))})
    return parts.withColumn("kg_m", geodesic_m(F.col("kg_plat"), F.col("kg_plon"), F.col("kg_qlat"), F.col("kg_qlon")))


def swept_ratio(cells: DataFrame, years: float | None = None) -> DataFrame:
    """Adds SAR (swept area over cell area, over all years unless divided), p_d (mean depth) and SVR."""
    sar = F.col("sum_dw") / F.lit(CELL_AREA_M2 * (years or 1.0))
    depth = F.when(F.col("sum_dw") == 0, 0.0).otherwise(F.col("sum_dw_pd") / F.col("sum_dw"))
    return cells.withColumn("sar", sar).withColumn("p_d", depth).withColumn("svr", F.col("sar") * F.col("p_d"))


def _usable(most_km: float) -> list[Column]:
    """Of pings whose pl_eff is usable (finite, the sample near enough) their number and sum."""
    usable = F.col("pl_eff").isNotNull() & ~F.isnan("pl_eff") & (F.col("dist_km").isNull() | (F.col("dist_km") <= most_km))
    return [F.count(F.when(usable, 1)).alias("n_with_pl"), F.sum(F.when(usable, F.col("pl_eff"))).alias("pl_sum")]


def _marks(period: Column | None) -> tuple[Column, Column]:
    """A period's range of 64, and the bits of a range's periods."""
    year = (F.year("ts") if period is None else period).cast("long")
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), year.bitwiseAND(63).cast("int"))
    return F.shiftright(year, 6).alias("kg_range"), F.bit_or(mark).alias("kg_marks")


def _marked() -> Column:
    return F.coalesce(F.sum(F.bit_count("kg_marks")), F.lit(0)).alias("years_trawled")


def lability(pings: DataFrame, most_km: float = 10.0) -> DataFrame:
    """Per cell: pings whose pl_eff is usable (finite, the sample near enough), their sum, and the plain mean."""
    by = pings.where("grid_id is not null").groupBy("grid_id").agg(*_usable(most_km))
    return by.withColumn("p_l", F.try_divide("pl_sum", "n_with_pl"))


def duration_years(pings: DataFrame, period: Column | None = None) -> DataFrame:
    """In how many different years (or other periods, by whole numbers) a cell has pings; unknown ones do not count. Periods are marked in
    ranges of 64, so a cell's pings are one row before they are shuffled."""
    within, marks = _marks(period)
    return pings.where("grid_id is not null").groupBy("grid_id", within).agg(marks).groupBy("grid_id").agg(_marked())


def lability_and_years(pings: DataFrame, period: Column | None = None, most_km: float = 10.0) -> DataFrame:
    """lability and duration_years of the same pings, which are worked out once."""
    within, marks = _marks(period)
    by = pings.where("grid_id is not null").groupBy("grid_id", within).agg(*_usable(most_km), marks)
    by = by.groupBy("grid_id").agg(F.sum("n_with_pl").alias("n_with_pl"), F.sum("pl_sum").alias("pl_sum"), _marked())
    return by.withColumn("p_l", F.try_divide("pl_sum", "n_with_pl"))


def merged(*parts: DataFrame) -> DataFrame:
    """Sums of partial cell tables."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.groupBy("grid_id").agg(*(F.sum(c).alias(c) for c in out.columns if c != "grid_id"))
