"""Points in polygons: provinces and land masks of few vertices, and rectangles.

Polygons of at most MOST_VERTICES vertices are collected behind that check and sent to the executors; larger layers go
through the index of `operators/polygons.py`, which gives the same answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelgrid.operators import polygons as named_polygons

MOST_VERTICES, BIN = 5_000_000, 4.0


def in_rectangles(points: DataFrame, rectangles: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Left join of points with half-open rectangles (lon0, lon1, lat0, lat1) in degrees. Rectangles are laid into bins of
    BIN degrees and meet the points of their bins in an equi join; how they are sent is Spark's choice by their size."""
    bin_ = lambda c: F.floor(c / F.lit(BIN)).cast("long")
    span = lambda a, b: F.explode(F.sequence(bin_(F.col(a)), F.greatest(bin_(F.col(a)), F.ceil(F.col(b) / F.lit(BIN)).cast("long") - 1)))
    r = rectangles.withColumn("kg_bi", span("lon0", "lon1")).withColumn("kg_bj", span("lat0", "lat1"))
    p = points.withColumn("kg_pi", bin_(F.col(x))).withColumn("kg_pj", bin_(F.col(y)))
    inside = (F.col(x) >= F.col("lon0")) & (F.col(x) < F.col("lon1")) & (F.col(y) >= F.col("lat0")) & (F.col(y) < F.col("lat1"))
    met = p.join(r, (F.col("kg_pi") == F.col("kg_bi")) & (F.col("kg_pj") == F.col("kg_bj")) & inside, "left")
    return met.drop("lon0", "lon1", "lat0", "lat1", "kg_bi", "kg_bj", "kg_pi", "kg_pj")


def even_odd(x: np.ndarray, y: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Whether points lie inside, by the even-odd rule over all rings (holes are rings too). Points on a lower or left edge
    are inside, on an upper or right one outside."""
    inside = np.zeros(len(x), bool)
    for ring in rings:
        x0, y0 = ring[:, 0], ring[:, 1]
        x1, y1 = np.roll(x0, -1), np.roll(y0, -1)
        for a, b, c, d in zip(x0, y0, x1, y1, strict=True):
            if b != d:
                inside ^= ((b > y) != (d > y)) & (x < (c - a) * (y - b) / (d - b) + a)
    return inside


def load_polygons(polygons: DataFrame, name: str = "province", rings: str = "rings") -> list[tuple[str, tuple[float, float, float, float], list[np.ndarray]]] | None:
    """Name, box and rings of each polygon; None if they are too large to be sent."""
    size = polygons.agg(F.sum(F.aggregate(rings, F.lit(0), lambda a, r: a + F.coalesce(F.size(r), F.lit(0))))).first()[0] or 0
    if size > MOST_VERTICES:
        return None
    out = []
    for row in polygons.select(name, rings).orderBy(name).collect():
        parts = [np.array([(p["x"], p["y"]) for p in ring], float) for ring in row[1] or [] if len(ring) >= 3]
        if parts:
            every = np.concatenate(parts)
            out.append((row[0], (*every.min(axis=0), *every.max(axis=0)), parts))
    return out


def in_polygons(points: DataFrame, polygons: DataFrame, x: str = "lon", y: str = "lat", name: str = "province") -> DataFrame:
    """Adds the name of the first polygon (by name) that holds the point, or null."""
    shapes = load_polygons(polygons, name)
    if shapes is None:
        found = named_polygons.names_at(points, named_polygons.index_of(polygons, name), x, y, out="kg_names")
        return found.withColumn(name, F.get("kg_names", F.lit(0))).drop("kg_names")

    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            px, py = xs.to_numpy(float), ys.to_numpy(float)
            found = np.full(len(px), None, object)
            for label, (x0, y0, x1, y1), rings in shapes:
                at = np.flatnonzero((found == None) & (px >= x0) & (px <= x1) & (py >= y0) & (py <= y1))  # noqa: E711
                if len(at):
                    found[at[even_odd(px[at], py[at], rings)]] = label
            yield pd.Series(found, dtype=object)

    return points.withColumn(name, F.pandas_udf(find, "string")(F.col(x).cast("double"), F.col(y).cast("double")))


def segments_meet(ax, ay, bx, by, ring: np.ndarray) -> np.ndarray:
    """Whether segments a-b cross an edge of the ring."""
    cx, cy = ring[:, 0], ring[:, 1]
    dx, dy = np.roll(cx, -1), np.roll(cy, -1)
    side = lambda px, py, qx, qy, rx, ry: np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))
    out = np.zeros(len(ax), bool)
    for i in range(len(cx)):
        s1, s2 = side(ax, ay, bx, by, cx[i], cy[i]), side(ax, ay, bx, by, dx[i], dy[i])
        s3, s4 = side(cx[i], cy[i], dx[i], dy[i], ax, ay), side(cx[i], cy[i], dx[i], dy[i], bx, by)
        out |= (s1 != s2) & (s3 != s4)
    return out


def land_flags(steps: DataFrame, land: DataFrame | None) -> DataFrame:
    """From rows with lon, lat and the ping before's lon0, lat0: on_land and crosses_land. Without a mask both are false."""
    if land is None:
        return steps.withColumn("on_land", F.lit(False)).withColumn("crosses_land", F.lit(False))
    shapes = load_polygons(land, "name")
    if shapes is None:
        return named_polygons.land_flags(steps, named_polygons.index_of(land))

    def on(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            px, py = xs.to_numpy(float), ys.to_numpy(float)
            yield pd.Series(np.any([even_odd(px, py, rings) for _, _, rings in shapes] or [np.zeros(len(px), bool)], axis=0))

    def cross(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for part in batches:
            a = [s.to_numpy(float) for s in part]
            yield pd.Series(np.any([segments_meet(*a, ring) for _, _, rings in shapes for ring in rings] or [np.zeros(len(a[0]), bool)], axis=0))

    out = steps.withColumn("on_land", F.pandas_udf(on, "boolean")("lon", "lat"))
    known = F.col("lon0").isNotNull()
    return out.withColumn("crosses_land", F.coalesce(known & F.pandas_udf(cross, "boolean")(F.coalesce("lon0", "lon"), F.coalesce("lat0", "lat"), "lon", "lat"), F.lit(False)))
