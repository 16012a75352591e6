"""Isolation forest per vessel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("lat", "lon", "dt_s", "speed")


def _usual(n: int) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def anomaly(x: np.ndarray, trees: int = 25, size: int = 256, seed: int = 42) -> np.ndarray:
    """Scores in (0, 1), larger for rows that random cuts isolate sooner. All rows go down each tree together, each with its own
    number, so that a node holds what it needs and looks nothing up; where the sample is all rows one table serves for both."""
    random, n = np.random.default_rng(seed), len(x)
    size, d = min(size, n), x.shape[1]
    most, depth = math.ceil(math.log2(max(size, 2))), np.zeros(n)
    usual = [_usual(k) for k in range(size + 1)]
    whole = size == n
    # Values, and their negatives, so that one minimum gives both bounds; the last column is the row's number.
    table = np.column_stack([x, -x, np.arange(n)])
    for _ in range(trees):
        sample = table[random.choice(n, size, replace=False)]
        work, ends, paths = [(sample, sample if whole else table, 0)], [], []
        while work:
            sample, rows, level = work.pop()
            wide = []
            if level < most and len(sample) > 1 and len(rows):
                low = np.minimum.reduce(sample, axis=0).tolist()
                wide = [f for f in range(d) if -low[d + f] > low[f]]
            if not wide:
                ends.append(rows[:, -1])
                paths.append(level + usual[len(sample)])
                continue
            f = wide[random.integers(0, len(wide))] if len(wide) > 1 else wide[0]
            cut = low[f] + (-low[d + f] - low[f]) * random.random()
            a = sample[:, f] < cut
            left, right = sample[a], sample[~a]
            if whole:
                work += ((left, left, level + 1), (right, right, level + 1))
            else:
                b = rows[:, f] < cut
                work += ((left, rows[b], level + 1), (right, rows[~b], level + 1))
        depth[np.concatenate(ends).astype(np.intp)] += np.repeat(paths, [len(e) for e in ends])
    return 2 ** (-depth / trees / max(_usual(size), 1e-9))


def outliers(df: DataFrame, key: str = "ssvid", contamination: float = 0.02, trees: int = 25, size: int = 256, least: int = 50, seed: int = 42) -> DataFrame:
    """Adds is_outlier: a score above the vessel's (1 - contamination) quantile. Rows with a missing input, and vessels with
    fewer than `least` whole rows, have none."""
    use = df.select(key, "ping_id", *FEATURES).dropna(subset=list(FEATURES))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ping_id")
        flag = np.zeros(len(pdf), bool)
        if len(pdf) >= least:
            score = anomaly(pdf[list(FEATURES)].to_numpy(float), trees, size, seed)
            flag = score > np.quantile(score, 1 - contamination)
        return pd.DataFrame({"ping_id": pdf["ping_id"], "is_outlier": flag})

    # Small rows but long work: a count given in figures keeps Spark from putting all groups into one task.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = use.repartition(tasks, key).groupBy(key).applyInPandas(one, "ping_id long, is_outlier boolean")
    return df.join(found, "ping_id", "left").withColumn("is_outlier", F.coalesce("is_outlier", F.lit(False)))
