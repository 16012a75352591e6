"""Written results: partitioned tables, reports, memoised stages, rasters."""

from __future__ import annotations

from collections.abc import Callable

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path; made and written first where it is missing, unfinished or `force` says so."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def write_by(df: DataFrame, path: str, key: str, order: list[str]) -> None:
    """One folder a value, rows in order, zstd."""
    df.repartition(key).sortWithinPartitions(key, *order).write.mode("overwrite").option("compression", "zstd").partitionBy(key).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report: one file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def checked_split(df: DataFrame, key: str) -> DataFrame:
    """Counts by key, or an error if they do not add up to the table."""
    counts = df.groupBy(key).agg(F.count("*").alias("rows"))
    if (total := counts.agg(F.sum("rows")).first()[0] or 0) != df.count():
        raise ValueError(f"the groups of {key} have {total} rows in all, the table has another number")
    return counts


def resolve_latest(paths: list[str], stamps: list[float] | None = None) -> str:
    """The newest path: by time stamp, else by name."""
    if not paths:
        raise ValueError("no input was found")
    return max(zip(stamps, paths, strict=True))[1] if stamps else max(paths)


def discover(paths: list[str], named: str | None = None, preferred: str = "") -> str:
    """The input to read: the named file if it is there; else a CSV file, first one whose name ends as `preferred` says; else
    a Parquet file."""
    if named and named in paths:
        return named
    tables = sorted(p for p in paths if p.lower().endswith(".csv"))
    best = [p for p in tables if preferred and p.lower().endswith(preferred.lower())]
    found = best or tables or sorted(p for p in paths if p.lower().rstrip("/").endswith(".parquet"))
    if not found:
        raise ValueError("no input was found")
    return found[0]


def records(spark: SparkSession, text: str, schema: str, key: str | None = None) -> DataFrame:
    """A table from a YAML list of records, or the list under `key`; fields that a record lacks are null."""
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    rows = load_yaml(text)
    rows = (rows.get(key) if key else rows) or []
    return spark.createDataFrame([tuple(r.get(f.name) for f in kind.fields) for r in rows], kind)


def write_ships(df: DataFrame, path: str, name: str = "ship") -> DataFrame:
    """One folder a ship, named by its rank in rows (most first, then by name) and its name made safe; returns what was
    written: ship, folder, rows."""
    ranked_ = df.groupBy(name).agg(F.count("*").alias("rows")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rows"), name)))
    ranked_ = ranked_.withColumn("folder", F.concat(F.lit("ship_"), F.format_string("%02d", "rank"), F.lit("_"), F.regexp_replace(F.col(name), "[^A-Za-z0-9_-]", "_")))
    write_by(df.join(ranked_.select(name, "folder"), name), path, "folder", [name])
    return ranked_.select(name, "folder", "rows")


def write_qa(df: DataFrame, path: str, ident: str = "ping_id") -> None:
    """The rows' id, time, posterior columns p1, p2, ... as there are, smoothed behaviour, score and flag."""
    wanted = [c for c in df.columns if c[:1] == "p" and c[1:].isdigit()]
    df.select(F.col(ident).alias("id"), "ts", *wanted, "behaviour_smooth", "drag_score", "drag_flag").write.mode("overwrite").option("compression", "zstd").parquet(path)


class _Strict(yaml.SafeLoader):
    """A loader that takes a repeated key for an error."""


def _mapping(loader: _Strict, node: yaml.MappingNode, deep: bool = False) -> dict:
    out: dict = {}
    for k, v in node.value:
        key = loader.construct_object(k, deep)
        if key in out:
            raise ValueError(f"{key!r} stands twice in {k.start_mark}")
        out[key] = loader.construct_object(v, True)
    return out


_Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)


def load_yaml(text: str) -> dict:
    return yaml.load(text, _Strict) or {}


def report_yaml(best: dict) -> str:
    return yaml.safe_dump(best, sort_keys=True, allow_unicode=True)


def report_markdown(title: str, df: DataFrame, rows: int = 20) -> str:
    """A short table (the first rows only: it is a report)."""
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in df.limit(rows).collect()]) + "\n"


def north_up(cells: DataFrame, rows: int) -> DataFrame:
    """Cells with raster_row counted from the north, for writers of images."""
    return cells.withColumn("raster_row", F.lit(rows - 1) - F.col("row"))
