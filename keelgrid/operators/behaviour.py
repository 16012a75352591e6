"""Behaviour of a vessel: Gaussian mixture over speed, acceleration and turning, labels, and their smoothing in time."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelgrid.functions.scalar import clamp
from keelgrid.operators.kinematics import order
from keelgrid.operators.quantiles import quantiles

FEATURES = ("speed", "norm_acc", "norm_turn")
#: What it costs to take a short run for its neighbour's behaviour.
STOP_COST, DREDGE_COST, OTHER_COST = 4, 3, 5


def scales(df: DataFrame) -> tuple[float, float]:
    """95th percentiles of |acceleration| and of turning; 1e-6 where 0, null or not finite."""
    found = quantiles(df, {"acc": F.abs("accel_ms2"), "turn": F.col("turn_deg")}, [0.95])
    return tuple(x if x and math.isfinite(x) and x > 0 else 1e-6 for (x,) in found.values())


def normed(df: DataFrame, acc: float, turn_: float) -> DataFrame:
    """Inputs of the mixture and of the score, all finite. What is cut to [0, 1] can only be null (a NaN is cut to 1), and the kernel null or NaN;
    no more is asked, as Java compiles no long methods."""
    cut = lambda x: F.coalesce(clamp(x), F.lit(0.0))
    return df.withColumns({
        "norm_acc": cut(F.abs("accel_ms2") / F.lit(acc)),
        "norm_turn": cut(F.col("turn_deg") / F.lit(turn_)),
        "norm_course": cut(1 - F.col("turn_deg") / F.lit(turn_)),
        "in_range": F.coalesce(F.col("speed").between(1.0, 3.5).cast("int"), F.lit(0)),
        "kernel": F.coalesce(F.nanvl(F.exp(-F.pow(F.col("speed") - 2.25, 2) / 2), F.lit(0.0)), F.lit(0.0)),
    })


def trainable() -> Column:
    return F.col("speed").between(0.5, 20.0) & F.col("norm_acc").isNotNull() & F.col("norm_turn").isNotNull()


@dataclass
class Mixture:
    k: int
    weights: list[float]
    means: list[list[float]]
    covariances: list[list[list[float]]]
    bic: float


def fit_mixture(df: DataFrame, ks: tuple[int, ...] = (3, 4, 5), features: tuple[str, ...] = FEATURES, rows: int | None = 2_000_000, ident: str = "ping_id", seed: int = 42, least: int = 200) -> Mixture:
    """The mixture with the largest 2 logLik - p ln n among ks, components by mean speed. Fitted on at most about `rows` rows
    (a documented sample, by a hash of the id), or with None on all, in Spark's own estimator."""
    # Plain columns are kept, not vectors: of vectors kept here Spark ML would unpack every one in every step.
    whole = df.select(*features, *([] if rows is None else [ident])).persist()
    count = whole.count()
    if count < least:
        whole.unpersist()
        raise ValueError(f"{count} rows are too few for a mixture; {least} are needed")
    data = whole if rows is None or count <= rows else whole.where(F.pmod(F.xxhash64(ident, F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * rows / count))
    n, d, best = count if data is whole else data.count(), len(features), None
    data = VectorAssembler(inputCols=list(features), outputCol="kg_x").transform(data).select("kg_x")
    for k in ks:
        m = GaussianMixture(featuresCol="kg_x", k=k, seed=seed, maxIter=60, tol=1e-3).fit(data)
        free = (k - 1) + k * d + k * d * (d + 1) // 2
        bic = 2 * m.summary.logLikelihood - free * math.log(n)
        if best is None or bic > best.bic:
            parts = sorted(((float(w), [float(x) for x in g.mean], g.cov.toArray().tolist()) for w, g in zip(m.weights, m.gaussians, strict=True)), key=lambda p: p[1][0])
            best = Mixture(k, [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts], bic)
    whole.unpersist()
    return best


def _density(x: list[Column], mean: list[float], cov: list[list[float]]) -> Column:
    """Normal density, by a Cholesky factor computed here; only arithmetic reaches Spark."""
    d = len(mean)
    low = [[0.0] * d for _ in range(d)]
    for i in range(d):
        for j in range(i + 1):
            s = cov[i][j] - sum(low[i][k] * low[j][k] for k in range(j))
            low[i][j] = math.sqrt(max(s, 1e-12)) if i == j else s / low[j][j]
    z: list[Column] = []
    for i in range(d):
        rest = x[i] - F.lit(mean[i])
        for k in range(i):
            if low[i][k]:
                rest = rest - F.lit(low[i][k]) * z[k]
        z.append(rest / F.lit(low[i][i]))
    square = sum((v * v for v in z[1:]), z[0] * z[0])
    return F.exp(F.lit(-0.5) * square) / F.lit((2 * math.pi) ** (d / 2) * math.prod(low[i][i] for i in range(d)))


def posterior(df: DataFrame, m: Mixture, features: tuple[str, ...] = FEATURES, stop: str = "is_stop_spatial") -> DataFrame:
    """Adds p: an array of the probability of stop (1 for spatial stops) and of each component; all 0 for rows that are
    neither stops nor trainable. Plain column arithmetic."""
    x = [F.col(c) for c in features]
    parts = [F.lit(w) * _density(x, mean, cov) for w, mean, cov in zip(m.weights, m.means, m.covariances, strict=True)]
    # Columns one after another, not an array: each density is worked out once, and what is used of p is all that is.
    own = [f"kg_d{i}" for i in range(m.k)]
    rows = df.withColumns(dict(zip(own, parts, strict=True)))
    rows = rows.withColumn("kg_all", sum((F.col(c) for c in own), F.lit(0.0)))
    stopped = F.coalesce(F.col(stop), F.lit(False))
    told = ~stopped & trainable() & (F.col("kg_all") > 0)
    share = [F.when(told, F.col(c) / F.col("kg_all")).otherwise(0.0) for c in own]
    return rows.withColumn("p", F.array(stopped.cast("double"), *share)).drop(*own, "kg_all")


def component_summary(df: DataFrame, m: Mixture, features: tuple[str, ...] = ("speed",)) -> DataFrame:
    """For each component (numbered from 1, by the mixture's order) the rows that are likeliest its own: their number, share, and
    mean, standard deviation, least and greatest value of the first feature. Rows with a missing feature are left out; a component
    without rows has none."""
    x = [F.col(c) for c in features]
    parts = [F.lit(w) * _density(x, mean, cov) for w, mean, cov in zip(m.weights, m.means, m.covariances, strict=True)]
    rows = df.dropna(subset=list(features)).withColumn("kg_d", F.array(*parts))
    own = rows.withColumn("component", F.array_position("kg_d", F.array_max("kg_d")))
    by = own.groupBy("component").agg(F.count("*").alias("n"), F.avg(x[0]).alias("mean"), F.stddev(x[0]).alias("sd"), F.min(x[0]).alias("least"), F.max(x[0]).alias("most"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def name_components(means: list[float]) -> list[str]:
    """Names by mean speed (ascending): the one in [1, 3.5] nearest 2 kn dredges (else the one nearest 2.25); those in
    (3.5, 6] manoeuvre; of the rest the slowest is loaded, the fastest unloaded, others are `other`."""
    inside = [i for i, v in enumerate(means) if 1 <= v <= 3.5]
    dredge = min(inside, key=lambda i: abs(means[i] - 2)) if inside else min(range(len(means)), key=lambda i: abs(means[i] - 2.25))
    names = ["other"] * len(means)
    names[dredge] = "dredging"
    rest = []
    for i, v in enumerate(means):
        if i == dredge:
            continue
        if 3.5 < v <= 6:
            names[i] = "slow_maneuvers"
        else:
            rest.append(i)
    if rest:
        names[rest[-1]] = "unloaded_transit"
        names[rest[0]] = "loaded_transit"
    return names


def labelled(df: DataFrame, names: list[str]) -> DataFrame:
    """behaviour: the name of the largest probability, the first on ties (so `stops` where all are 0)."""
    labels = F.array(*(F.lit(n) for n in ("stops", *names)))
    return df.withColumn("behaviour", F.element_at(labels, F.array_position("p", F.array_max("p")).cast("int")))


def runs(df: DataFrame, label: str = "behaviour", key: str = "seg_id") -> DataFrame:
    """Maximal runs of one label in a segment: run (from 1), label, length, mean speed, first and last ping."""
    w = order(key)
    starts = (~F.col(label).eqNullSafe(F.lag(label).over(w))) | (F.row_number().over(w) == 1)
    numbered = df.withColumn("kg_start", starts.cast("int")).withColumn("run", F.sum("kg_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by = numbered.groupBy(key, "run").agg(F.first(label).alias("label"), F.count("*").alias("length"), F.avg("speed").alias("mean_speed"), F.min_by("ping_id", F.struct("ts", "ping_id")).alias("first_ping"), F.max_by("ping_id", F.struct("ts", "ping_id")).alias("last_ping"))
    return by


def cost(a: str, b: str) -> int:
    if a == b:
        return 0
    if "stops" in (a, b):
        return DREDGE_COST if "dredging" in (a, b) else STOP_COST
    return DREDGE_COST if "dredging" in (a, b) else OTHER_COST


def smooth(labels: list[str], speeds: list[float], least: float, dredge_max: float = 3.5) -> list[str | None]:
    """Runs shorter than `least` with a mean speed up to dredge_max take a neighbour's label: the left one's (as already
    smoothed) if that is cheaper, else the right one's; None where there is none. Run lengths stay."""
    bounds = [i for i in range(len(labels)) if i == 0 or labels[i] != labels[i - 1]] + [len(labels)]
    names = [labels[a] for a in bounds[:-1]]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if b - a >= least or not sum(speeds[a:b]) / (b - a) <= dredge_max:
            continue
        left = names[i - 1] if i else None
        right = names[i + 1] if i + 1 < len(names) else None
        to = lambda other: math.inf if other is None else cost(other, names[i])  # noqa: B023, E731
        names[i] = left if to(left) < to(right) else right
    return [names[i] for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) for _ in range(b - a)]


def least_length(df: DataFrame, share: float = 0.75) -> float:
    """The run length from which runs stay: the quantile of the pings' n_min, which comes from their vessel's cadence."""
    return df.agg(F.percentile("n_min", F.lit(share))).first()[0] or 3.0


def smoothed(df: DataFrame, least: float, key: str = "seg_id", label: str = "behaviour") -> DataFrame:
    """Adds behaviour_smooth (`unknown` where no neighbour could be taken) and is_dredging. A segment is one vessel's day.

    Segments are short and many, so they are not groups of their own: rows come sorted and a batch's whole segments are smoothed
    together; only a segment that a batch cuts waits for the next one."""
    schema = T.StructType([*df.schema.fields, T.StructField("behaviour_smooth", T.StringType())])

    def starts(t: pa.Table) -> np.ndarray:
        code = t.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        return np.append(0, np.flatnonzero(code[1:] != code[:-1]) + 1)

    def done(t: pa.Table, at: list[int]) -> Iterator[pa.RecordBatch]:
        labels, speeds = t.column(label).to_pylist(), t.column("speed").cast(pa.float64()).to_numpy().tolist()
        names = [x or "unknown" for a, b in zip(at, [*at[1:], t.num_rows], strict=True) for x in smooth(labels[a:b], speeds[a:b], least)]
        yield from t.append_column("behaviour_smooth", pa.array(names, pa.string())).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            ends = pa.Table.from_batches([held[0].slice(0, 1), batch.slice(batch.num_rows - 1)])
            if len(starts(ends)) == 1:
                continue  # all of one segment so far
            t = pa.Table.from_batches(held)
            at = starts(t).tolist()
            yield from done(t.slice(0, at[-1]), at[:-1])
            held = t.slice(at[-1]).to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield from done(t, starts(t).tolist())

    rows = df.repartition(key).sortWithinPartitions(F.col(key), F.col("ts").asc_nulls_last(), F.col("ping_id").asc_nulls_last())
    return rows.mapInArrow(run, schema).withColumn("is_dredging", (F.col("behaviour_smooth") == "dredging").cast("int"))
