"""Nearest seabed sample of a ping, and a box of samples around the pings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelgrid.functions.scalar import EQUATOR_M, haversine_m

#: Width of a bin in degrees at first and at least, sampled places of a bin on average, bins and places that are sent to the executors at
#: most, and distances worked out at once.
BIN_DEG, LEAST_DEG, BIN_SAMPLES, MOST_BINS, MOST_PLACES, AT_ONCE = 0.5, 1 / 1024, 256, 1_000_000, 100_000, 1_000_000
_BEST = ("seabed_id", "s_lon", "s_lat", "lithology", "pl_base")


def _width(n: int, many_at: Callable[[float], int], width: float) -> float:
    """Bins are halved while they hold many of the n places each (in tight clusters the first halvings may not part any) and
    doubled while there are too many of them."""
    many = many_at(width)
    while many > MOST_BINS:
        width *= 2
        many = many_at(width)
    finer = width
    while n > BIN_SAMPLES * many and finer > LEAST_DEG:
        finer /= 2
        now = many_at(finer)
        if now > MOST_BINS:
            break
        if now > many:
            width, many = finer, now
    return width


def _occupied(samples: DataFrame, width: float) -> tuple[np.ndarray, float]:
    """The bins that have samples, at most MOST_BINS, by column and row."""
    bins = lambda w: samples.select(_bin("lon", w).alias("i"), _bin("lat", w).alias("j")).distinct()
    width = _width(samples.select("lon", "lat").distinct().count(), lambda w: bins(w).count(), width)
    found = bins(width).toPandas().to_numpy(np.int64).reshape(-1, 2)
    return found[np.lexsort((found[:, 1], found[:, 0]))], width


def _which(bins: np.ndarray, a: int, b: int) -> np.ndarray:
    """Of the sorted bins the numbers of those that can hold the nearest sample of a point in bin (a, b): a band of columns is widened
    until it has a bin that is surely nearer than all outside. Squares are in units of a bin: whole numbers, so comparisons are exact."""
    r = 4
    while True:
        lo, hi = np.searchsorted(bins[:, 0], (a - r, a + r + 1))
        apart = np.abs(bins[lo:hi] - (a, b))
        least, most = np.maximum(apart - 1, 0), apart + 1
        reach = (most * most).sum(axis=1).min() if hi > lo else None
        if hi - lo == len(bins) or (reach is not None and r * r > reach):
            return lo + np.flatnonzero((least * least).sum(axis=1) <= reach)
        r *= 4


def _within(bins: np.ndarray, a: int, b: int) -> np.ndarray:
    return bins[_which(bins, a, b)]


def _bin(c: str, width: float) -> Column:
    return F.floor(F.col(c) / F.lit(width)).cast("long")


def repeated_ids(pings: DataFrame) -> bool:
    """Whether a ping_id stands in more than one row, null ones aside. Ids are marked in ranges of 64: where they are dense,
    little of them is shuffled."""
    marks = pings.where("ping_id is not null").groupBy(F.shiftright("ping_id", 6)).agg(F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, cast(ping_id & 63 as int))")).alias("m"))
    return not marks.where(F.col("n") > F.bit_count("m")).isEmpty()


def _search(places: np.ndarray, width: float) -> Callable:
    """Finds the number of the place that is nearest a point, the first of several; null where a coordinate is missing or not finite.
    A bin's points are compared with the places in bins that can hold their nearest, at most AT_ONCE pairs at once."""
    cells = lambda xy, w: np.floor(xy / w).astype(np.int64)
    width = _width(len(places), lambda w: len(np.unique(cells(places, w), axis=0)), width)
    own = cells(places, width)
    order = np.lexsort((own[:, 1], own[:, 0]))
    bins, first = np.unique(own[order], axis=0, return_index=True)
    ends = np.append(first, len(places))

    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[tuple[int, int], np.ndarray] = {}
        room = 4 * AT_ONCE

        def near(a: int, b: int) -> np.ndarray:
            nonlocal room
            if (a, b) in known:
                return known[a, b]
            got = np.sort(np.concatenate([order[ends[k] : ends[k + 1]] for k in _which(bins, a, b)]))
            if len(got) <= room:
                known[a, b], room = got, room - len(got)
            return got

        for xs, ys in batches:
            xy = np.column_stack((xs.to_numpy(float), ys.to_numpy(float)))
            out, at = np.full(len(xy), np.nan), np.flatnonzero(np.isfinite(xy).all(axis=1))
            mine = cells(xy[at], width)
            by = np.lexsort((mine[:, 1], mine[:, 0]))
            at, mine = at[by], mine[by]
            cuts = np.flatnonzero((mine[1:] != mine[:-1]).any(axis=1)) + 1
            for rows, (a, b) in zip(np.split(at, cuts), mine[np.append(0, cuts)].tolist(), strict=True) if len(at) else ():
                some = near(a, b)
                for k in range(0, len(rows), step := max(1, AT_ONCE // len(some))):
                    dx, dy = (xy[rows[k : k + step], c, None] - places[some, c] for c in (0, 1))
                    out[rows[k : k + step]] = some[(dx * dx + dy * dy).argmin(axis=1)]
            yield pd.Series(out).astype("Int64")

    return find


def nearest(pings: DataFrame, samples: DataFrame, width: float = BIN_DEG, repeated: bool | None = None) -> DataFrame:
    """Adds the nearest sample in degrees at whatever distance (ties: the smallest seabed_id), and dist_km on the sphere.

    Exact: the pings' bins are compared with the samples' occupied bins, whose number is bounded by the globe and checked. A
    bin's pings can have their nearest sample only in bins no farther than the least distance within which some bin surely has one.
    Of samples at one place the smallest stands for all. At most MOST_PLACES places are collected behind that check and sent
    to the executors, where pings find theirs as they are read: nothing of the pings is shuffled. More places are met in equi joins. Rows that
    share a ping_id share the nearest of their samples, so they are grouped where an id is repeated; a caller that knows says so (else it is
    looked for). Pings without an id or a finite place, and all where there are no samples, get none."""
    if repeated is None:
        repeated = repeated_ids(pings)
    known = "lon - lon = 0 and lat - lat = 0"
    grid = samples.where(known).groupBy(F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat")).agg(F.min(F.struct("seabed_id", "lithology", "pl_base")).alias("s")).select("s.seabed_id", "s_lon", "s_lat", "s.lithology", "s.pl_base")
    few = grid.limit(MOST_PLACES + 1).orderBy("seabed_id", "s_lon", "s_lat").toArrow()
    own = F.when(F.col("ping_id").isNotNull(), F.col("lon"))
    if not len(few):
        found = pings.select("*", *(F.lit(None).cast(grid.schema[c].dataType).alias(c) for c in _BEST))
    elif len(few) <= MOST_PLACES:
        find = F.pandas_udf(_search(np.column_stack([few[c].to_numpy() for c in ("s_lon", "s_lat")]), width), "long")
        places = pings.sparkSession.createDataFrame(few.append_column("kg_place", pa.array(range(len(few)), pa.int64())))
        found = pings.withColumn("kg_place", find(own.cast("double"), F.col("lat").cast("double"))).join(F.broadcast(places), "kg_place", "left").drop("kg_place")
    else:
        met = _by_joins(pings.where(known), samples.where(known), grid, width).withColumnsRenamed({"lon": "kg_lon", "lat": "kg_lat"})
        found = pings.join(met, (own == F.col("kg_lon")) & (F.col("lat") == F.col("kg_lat")), "left").drop("kg_lon", "kg_lat")
    if repeated:
        d2 = (F.col("lon") - F.col("s_lon")) * (F.col("lon") - F.col("s_lon")) + (F.col("lat") - F.col("s_lat")) * (F.col("lat") - F.col("s_lat"))
        best = found.where("s_lon is not null").groupBy("ping_id").agg(F.min(F.struct(d2.alias("d2"), *_BEST)).alias("b")).select("ping_id", *(f"b.{c}" for c in _BEST))
        found = pings.join(best, "ping_id", "left")
    dist = haversine_m(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"), EQUATOR_M) / 1000
    return found.withColumn("dist_km", dist).select(*pings.columns, "seabed_id", "lithology", "pl_base", "dist_km")


def _by_joins(pings: DataFrame, samples: DataFrame, grid: DataFrame, width: float) -> DataFrame:
    """For each place of pings (lon, lat) its nearest sample. Each is searched for once, in equi joins whose large partitions Spark
    splits. First comes the least distance, then the samples at it: the pairs are only summed up in hash tables of numbers, neither
    sorted nor written."""
    bins, w = _occupied(samples, width)

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            met = [_within(bins, a, b) for a, b in zip(pdf["pi"].to_numpy(), pdf["pj"].to_numpy(), strict=True)]
            rows = np.repeat(np.arange(len(met)), [len(x) for x in met])
            at = np.concatenate(met) if met else np.zeros((0, 2), np.int64)
            yield pd.DataFrame({"pi": pdf["pi"].to_numpy()[rows], "pj": pdf["pj"].to_numpy()[rows], "bi": at[:, 0], "bj": at[:, 1]})

    spots = pings.select("lon", "lat").distinct()
    in_bins = lambda df: df.withColumns({"pi": _bin("lon", w), "pj": _bin("lat", w)})
    near = in_bins(pings).select("pi", "pj").distinct().mapInPandas(reach, "pi long, pj long, bi long, bj long")
    met = near.join(grid.withColumns({"bi": _bin("s_lon", w), "bj": _bin("s_lat", w)}), ["bi", "bj"]).drop("bi", "bj")
    d2 = (F.col("lon") - F.col("s_lon")) * (F.col("lon") - F.col("s_lon")) + (F.col("lat") - F.col("s_lat")) * (F.col("lat") - F.col("s_lat"))
    least = met.select("pi", "pj", "s_lon", "s_lat").join(in_bins(spots), ["pi", "pj"]).groupBy("lon", "lat").agg(F.min(d2).alias("least"))
    best = met.join(in_bins(least), ["pi", "pj"]).where(d2 == F.col("least")).groupBy("lon", "lat").agg(F.min(F.struct(*_BEST)).alias("b"))
    return best.select("lon", "lat", "b.*")


def near_enough(most_km: float = 10.0) -> Column:
    return F.coalesce(F.col("dist_km") <= most_km, F.lit(False))


def split(df: DataFrame, most_km: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Rows with a sample near enough, and all the others."""
    return df.where(near_enough(most_km)), df.where(~near_enough(most_km))


def box(df: DataFrame, margin_deg: float = 0.05) -> tuple[float, float, float, float] | None:
    """Bounding box of lon and lat with a margin."""
    r = df.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    return None if r[0] is None else (r[0] - margin_deg, r[1] + margin_deg, r[2] - margin_deg, r[3] + margin_deg)


def inside(df: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Half-open: a point on the upper or right edge belongs to the next box, so boxes that touch count it once."""
    return df.where((F.col("lon") >= bounds[0]) & (F.col("lon") < bounds[1]) & (F.col("lat") >= bounds[2]) & (F.col("lat") < bounds[3]))
