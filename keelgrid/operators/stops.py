"""Places where a vessel stops: density clusters per vessel and year."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelgrid.functions.scalar import EQUATOR_M

MIN_POINTS, SAMPLE = 4, 5000


def meet(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether a point of a is within eps of a point of b. Boxes around halves of both decide for most pairs."""
    work = [(a, b)]
    while work:
        a, b = work.pop()
        low_a, high_a, low_b, high_b = a.min(axis=0), a.max(axis=0), b.min(axis=0), b.max(axis=0)
        if (np.maximum(0, np.maximum(low_a - high_b, low_b - high_a)) ** 2).sum() > eps * eps:
            continue
        if (np.maximum(high_a - low_b, high_b - low_a) ** 2).sum() <= eps * eps:
            return True
        if len(a) * len(b) <= 4096:
            if (((a[:, None] - b) ** 2).sum(axis=2) <= eps * eps).any():
                return True
            continue
        if len(a) < len(b):
            a, b = b, a
        axis, half = int(np.argmax(np.ptp(a, axis=0))), len(a) // 2
        order = np.argpartition(a[:, axis], half)
        work += [(a[order[:half]], b), (a[order[half:]], b)]
    return False


def dbscan(xy: np.ndarray, eps: float, min_points: int = MIN_POINTS) -> np.ndarray:
    """Cluster numbers from 1 in the order of their first core points, 0 for noise; a border point goes to the cluster of
    the least number. All points of a grid cell are within eps of each other, so the points of a full cell are core without
    a look at pairs, and cells, not points, are joined: a crowded place costs no more than its number of points."""
    n = len(xy)
    label, core = np.zeros(n, np.int64), np.zeros(n, bool)
    if not n:
        return label
    cell = np.floor(xy / (eps / np.sqrt(2) * (1 - 1e-9))).astype(np.int64)
    order = np.lexsort((cell[:, 1], cell[:, 0]))
    cuts = np.flatnonzero((np.diff(cell[order], axis=0) != 0).any(axis=1)) + 1
    groups = {tuple(cell[part[0]].tolist()): part for part in np.split(order, cuts)}
    beside = [(p, q) for p in range(-2, 3) for q in range(-2, 3) if (p, q) != (0, 0)]
    around = lambda k, of: [of[c] for p, q in beside if (c := (k[0] + p, k[1] + q)) in of]
    near = lambda i, part: ((xy[part] - xy[i]) ** 2).sum(axis=1) <= eps * eps
    for k, part in groups.items():
        if len(part) >= min_points:
            core[part] = True
            continue
        others = around(k, groups)
        for i in part.tolist():
            core[i] = len(part) + sum(int(near(i, other).sum()) for other in others) >= min_points
    cores = {k: own for k, part in groups.items() if len(own := part[core[part]])}
    parent = {k: k for k in cores}

    def root(k: tuple[int, int]) -> tuple[int, int]:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, own in cores.items():
        for p, q in beside:
            c = (k[0] + p, k[1] + q)
            if c > k and c in cores and root(k) != root(c) and meet(xy[own], xy[cores[c]], eps):
                parent[root(c)] = root(k)
    first: dict[tuple[int, int], int] = {}
    for k, own in cores.items():
        first[root(k)] = min(first.get(root(k), n), int(own.min()))
    number = {k: at + 1 for at, k in enumerate(sorted(first, key=first.__getitem__))}
    for k, own in cores.items():
        label[own] = number[root(k)]
    for i in np.flatnonzero(~core).tolist():
        k = tuple(cell[i].tolist())
        reached = [label[own[0]] for own in [*around(k, cores), *([cores[k]] if k in cores else [])] if near(i, own).any()]
        label[i] = min(reached, default=0)
    return label


def auto_eps(lon: np.ndarray, lat: np.ndarray, k: int = MIN_POINTS, sample: int = SAMPLE, least_m: float = 200.0) -> float:
    """Radius in degrees: 1 % of the median distance to the k-th neighbour, least_m at least; from a fixed sample of at most
    `sample` points."""
    if len(lon) > sample:
        at = np.random.default_rng(123).choice(len(lon), sample, replace=False)
        lon, lat = lon[at], lat[at]
    a, b = np.radians(lon), np.radians(lat)
    kth = []
    for i in range(len(a)):
        h = np.sin((b - b[i]) / 2) ** 2 + np.cos(b) * np.cos(b[i]) * np.sin((a - a[i]) / 2) ** 2
        d = 2 * EQUATOR_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
        kth.append(np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)])
    return max(least_m, 0.01 * float(np.median(kth))) / 111_000


def spatial_stops(df: DataFrame, key: str = "ssvid", min_points: int = MIN_POINTS) -> DataFrame:
    """Adds stop_cluster (null for pings that are no stops, 0 for noise) and is_stop_spatial. A vessel-year with too few or
    coinciding stops has no clusters; where none is found the radius is tried once half as wide again. One vessel-year's
    stops are one task's group."""
    stops = df.where(F.col("is_stop") & F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(key, F.year("ts").alias("year"), "ping_id", "lon", "lat")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ping_id")
        lon, lat = pdf["lon"].to_numpy(), pdf["lat"].to_numpy()
        label = np.zeros(len(pdf), np.int64)
        if len(pdf) >= min_points and lon.var(ddof=1) >= 1e-8 and lat.var(ddof=1) >= 1e-8:
            eps, xy = auto_eps(lon, lat), np.column_stack([lon, lat])
            label = dbscan(xy, eps, min_points)
            if not label.any():
                label = dbscan(xy, 1.5 * eps, min_points)
        return pd.DataFrame({"ping_id": pdf["ping_id"], "stop_cluster": label})

    # Small rows but long work: a count given in figures keeps Spark from putting all groups into one task.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stops.repartition(tasks, key, "year").groupBy(key, "year").applyInPandas(one, "ping_id long, stop_cluster long")
    out = df.join(found, "ping_id", "left")
    return out.withColumn("is_stop_spatial", F.coalesce(F.col("is_stop") & (F.col("stop_cluster") > 0), F.lit(False)))
