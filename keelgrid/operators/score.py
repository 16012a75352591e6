"""Dredging score: ridge logistic regression checked year by year, ROC, threshold, scaled weights."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNALS = ("p_dredge", "norm_course", "norm_acc", "in_range", "kernel")


def year_folds(df: DataFrame, column: str = "year") -> DataFrame:
    """Adds fold, the dense rank of the year: ranked over the distinct years only, then joined back."""
    ranks = df.select(column).distinct().select(column, F.dense_rank().over(Window.orderBy(column)).cast("long").alias("fold"))
    return df.join(F.broadcast(ranks), column, "left")


@dataclass
class Ridge:
    coefficients: list[float]
    intercept: float
    folds: dict[int, float | None] = field(default_factory=dict)
    mean: float | None = None
    sd: float | None = None

    def weights(self) -> list[float]:
        """Shares of the coefficients' sizes."""
        total = sum(map(abs, self.coefficients))
        return [abs(x) / total if total else 0.0 for x in self.coefficients]


def check_classes(df: DataFrame, label: str, positives: int, negatives: int) -> None:
    row = df.agg(F.sum(F.col(label)), F.sum(1 - F.col(label))).first()
    if (row[0] or 0) < positives or (row[1] or 0) < negatives:
        raise ValueError(f"{row[0] or 0} positive and {row[1] or 0} negative rows; {positives} and {negatives} are needed")


def _fit_together(data: DataFrame, xs: list[str], keys: list[tuple[int, int, float]], cells: list[dict], passes: int = 100, near: float = 1e-9) -> list[np.ndarray]:
    """Coefficients and intercept of one ridge model for each key (fold and inner fold left out, or -1; strength), by Newton's method.

    The loss is Spark ML's: mean log loss plus half the strength times the squared coefficients of signals scaled by their
    standard deviations in the training rows; the intercept is free, a constant signal gets 0. One pass over data serves all models, so the number
    of jobs is that of Newton's steps, whatever the number of models. Steps that do not lower the loss are halved."""
    d = len(xs)
    of = np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64)
    n, varies, penalty, w = np.zeros(len(keys)), np.ones((len(keys), d + 1), bool), np.zeros((len(keys), d + 1)), np.zeros((len(keys), d + 1))
    for at, (f, i, strength) in enumerate(keys):
        part = [c for c in cells if c["kg_f"] != f and c["kg_i"] != i]
        each = np.array([c["n"] for c in part], float)
        n[at], y = each.sum(), sum(c["y"] for c in part)
        w[at, d] = math.log(y / (n[at] - y))
        for k, x in enumerate(xs):
            m = np.array([c[f"m{x}"] for c in part])
            spread = (each * (np.array([c[f"v{x}"] for c in part]) + (m - (each * m).sum() / n[at]) ** 2)).sum()
            # What rounding leaves of a constant is none.
            varies[at, k] = spread > 1e-24 * (each * m * m).sum()
            penalty[at, k] = strength * spread / max(n[at] - 1, 1)
    upper = np.triu_indices(d + 1)

    def sums(which: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each model of which: the loss, its gradient and the upper half of its second derivatives, summed over its rows."""
        fold, inner_, weights = of[0][which], of[1][which], at.T.copy()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((len(fold), 1 + d + 1 + len(upper[0])))
            for batch in batches:
                for start in range(0, batch.num_rows, 8192):
                    b = batch.slice(start, 8192)
                    x = np.column_stack([*(b.column(k).to_numpy() for k in range(d)), np.ones(b.num_rows)])
                    y = b.column(d).to_numpy()[:, None]
                    use = (b.column(d + 1).to_numpy()[:, None] != fold) & (b.column(d + 2).to_numpy()[:, None] != inner_)
                    z = x @ weights
                    small = np.exp(-np.abs(z))
                    p = np.where(z >= 0, 1.0, small) / (1 + small)
                    found[:, 0] += ((np.maximum(z, 0) + np.log1p(small) - y * z) * use).sum(axis=0)
                    found[:, 1 : d + 2] += ((p - y) * use).T @ x
                    found[:, d + 2 :] += (p * (1 - p) * use).T @ (x[:, upper[0]] * x[:, upper[1]])
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["sums"])

        rows = data.select(*xs, "kg_y", "kg_f", "kg_i").mapInArrow(run, "sums binary").collect()
        return np.sum([np.frombuffer(r[0]).reshape(len(fold), -1) for r in rows], axis=0) / n[which][:, None]

    base, loss, open_ = w.copy(), np.full(len(keys), np.inf), np.arange(len(keys))
    for _ in range(passes):
        if not len(open_):
            break
        going = []
        for m, row in zip(open_, sums(open_, w[open_]), strict=True):
            now = row[0] + 0.5 * (penalty[m] * w[m] ** 2).sum()
            if now > loss[m]:
                w[m] = (base[m] + w[m]) / 2
                step = w[m] - base[m]
            else:
                base[m], loss[m] = w[m], now
                second = np.zeros((d + 1, d + 1))
                second[upper] = row[d + 2 :]
                second = second + np.triu(second, 1).T + np.diag(penalty[m])
                some, step = varies[m], np.zeros(d + 1)
                step[some] = np.linalg.lstsq(second[np.ix_(some, some)], -(row[1 : d + 2] + penalty[m] * w[m])[some], rcond=None)[0]
                w[m] = base[m] + step
            if np.abs(step).max() > near * max(1.0, np.abs(base[m]).max()):
                going.append(m)
        open_ = np.array(going, np.int64)
    return list(base)


def fit_ridge(df: DataFrame, label: str = "is_dredging", fold: str = "fold", signals: tuple[str, ...] = SIGNALS, strengths: tuple[float, ...] = (0.1, 0.01, 0.001), positives: int = 100, negatives: int = 1000, least_train: int = 100, least_test: int = 10, ident: str = "ping_id") -> Ridge:
    """Leaves out one fold after another. The strength is the one with the best mean area under the curve over five inner
    folds (by a hash of the id; those without both labels do not count); the model kept is that of the fold whose area is nearest the mean. A fold that
    can't be trained or tested has no area and does not count."""
    check_classes(df, label, positives, negatives)
    inner = F.pmod(F.xxhash64(ident, F.lit(42)), F.lit(5)).cast("int")
    xs = [f"kg_x{k}" for k in range(len(signals))]
    data = df.select(*(F.col(c).cast("double").alias(x) for c, x in zip(signals, xs, strict=True)), F.col(label).cast("double").alias("kg_y"), F.col(fold).cast("long").alias("kg_f"), inner.alias("kg_i"))
    # Materialised without its lineage, which some hundred jobs would otherwise plan anew, and in as few partitions as its size asks for.
    data = data.localCheckpoint()
    auc = BinaryClassificationEvaluator(rawPredictionCol="kg_r", labelCol="kg_y")
    facts = [F.count("*").alias("n"), F.sum("kg_y").alias("y"), *(f(x).alias(f"{n}{x}") for x in xs for n, f in (("m", F.avg), ("v", F.var_pop)))]
    cells = [r.asDict() for r in data.groupBy("kg_f", "kg_i").agg(*facts).collect()]
    if not all(v is not None and math.isfinite(v) for c in cells for v in c.values()):
        raise ValueError("a signal, label or fold is missing or not finite")
    size = lambda part: (sum(c["n"] for c in part), sum(c["y"] for c in part))
    total, ones = size(cells)
    out, good = {}, {}
    for f in sorted({c["kg_f"] for c in cells}):
        n, y = size([c for c in cells if c["kg_f"] == f])
        if n < least_test or total - n < least_train or not 0 < y < n or not 0 < ones - y < total - n:
            out[f] = None
            continue
        out[f], held = 0.0, {i: size([c for c in cells if c["kg_f"] != f and c["kg_i"] == i]) for i in range(5)}
        good[f] = [i for i, (m, o) in held.items() if len(strengths) > 1 and 0 < o < m and 0 < ones - y - o < total - n - m]
    # All models are fitted together: those of the inner folds, and one a strength without a fold.
    keys = [(f, i, s) for f in good for s in strengths for i in (-1, *good[f])]
    fitted = dict(zip(keys, _fit_together(data, xs, keys, cells), strict=True))

    def area(k: tuple[int, int, float]) -> float:
        """Of a model on what it was not trained on: its inner fold, or its fold."""
        test = data.where((F.col("kg_f") != k[0]) & (F.col("kg_i") == k[1]) if k[1] >= 0 else F.col("kg_f") == k[0])
        w = fitted[k].tolist()
        return auc.evaluate(test.select(sum((F.lit(a) * F.col(x) for a, x in zip(w, xs, strict=False)), F.lit(w[-1])).alias("kg_r"), "kg_y"))

    with ThreadPool(5) as pool:  # many small jobs, which Spark runs side by side
        areas = dict(zip(asked := [k for k in keys if k[1] >= 0], pool.map(area, asked), strict=True))
        best = {f: max(strengths, key=lambda s: (sum(areas[f, i, s] for i in good[f]), s)) for f in good}  # noqa: B023
        out |= dict(zip(best, pool.map(area, [(f, -1, s) for f, s in best.items()]), strict=True))
    models = {f: fitted[f, -1, s] for f, s in best.items()}
    found = [a for a in out.values() if a is not None]
    if not found:
        raise ValueError("no fold could be trained and tested")
    mean = sum(found) / len(found)
    sd = math.sqrt(sum((a - mean) ** 2 for a in found) / (len(found) - 1)) if len(found) > 1 else None
    kept = models[min(models, key=lambda f: (abs(out[f] - mean), f))]
    return Ridge(kept[:-1].tolist(), float(kept[-1]), out, mean, sd)


def score(model: Ridge, signals: tuple[str, ...] = SIGNALS) -> Column:
    """Probability, as column arithmetic; a null signal gives 0."""
    z = F.lit(model.intercept)
    for c, w in zip(signals, model.coefficients, strict=True):
        z = z + F.lit(w) * F.col(c)
    return F.coalesce(1 / (1 + F.exp(-z)), F.lit(0.0))


def roc(df: DataFrame, score_col: str, label: str) -> DataFrame:
    """One row a distinct score, descending: true and false positive rate of `score >= threshold`, and Youden's J.

    Rows are summed by score first. The running sums go over ranges of scores: each range is summed in its own task, and
    only the ranges' totals, at most 1024, meet in one."""
    by = df.groupBy(F.col(score_col).alias("threshold")).agg(F.sum(label).alias("pos"), F.count("*").alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    bounds = F.least(F.greatest(F.floor(F.col("threshold") * 1024), F.lit(0)), F.lit(1023))
    by = by.withColumn("kg_range", bounds)
    total = by.groupBy("kg_range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    above = Window.orderBy(F.desc("kg_range")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy(F.desc("kg_range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = total.select("kg_range", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("q").over(above), F.lit(0)).alias("q0"), F.sum("p").over(all_).alias("np"), F.sum("q").over(all_).alias("nq"))
    inside = Window.partitionBy("kg_range").orderBy(F.desc("threshold"))
    rows = by.join(F.broadcast(total), "kg_range")
    tpr, fpr = (F.col("p0") + F.sum("pos").over(inside)) / F.col("np"), (F.col("q0") + F.sum("neg").over(inside)) / F.col("nq")
    return rows.select("threshold", tpr.alias("tpr"), fpr.alias("fpr")).withColumn("youden", F.col("tpr") - F.col("fpr"))


def youden(points: DataFrame) -> DataFrame:
    """The threshold with the largest J; ties: the largest threshold."""
    return points.orderBy(F.desc("youden"), F.desc("threshold")).limit(1)

