"""Lets Python workers import this package where its folder is one that they see."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> None:
    """Adds the package's folder to the workers' search path, for a session that was begun elsewhere. On a cluster whose
    machines do not share the folder, install the package or give it by --py-files; this then changes nothing."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def with_workers(query: Callable) -> Callable:
    @wraps(query)
    def run(spark: SparkSession, *args):
        importable(spark)
        return query(spark, *args)

    return run
