"""What the text operators share: folders that all executors see, batches, ids in blocks."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one id block, about.
BLOCK = 256
#: Ranges of ids that with_blocks looks at, a power of two.
COARSE = 1024
#: Blocks of one range up to which its ids are cut into equal spans without a closer look.
LONG_RANGE = 4


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, qualified by Hadoop's file systems; it goes when the session ends.

    Where that setting is unset (tests), below a temporary folder that is then set. Only a local master may do without
    it: on several machines each would write to its own disk."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="keelgrid-")
        spark.sparkContext.setCheckpointDir(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root, f"{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to a shared folder and read again: cuts the lineage, survives lost executors, evaluates Python once."""
    return written(df, shared_folder(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a shared folder through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a folder address (file, hdfs, s3, gs, as Spark spells them), and the path in it."""
    scheme, colon, rest = uri.partition(":")
    if colon and scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if colon and scheme in ("s3a", "s3n"):
        uri = "s3:" + rest
    return pafs.FileSystem.from_uri(uri)


def attempt() -> str:
    """Partition and attempt of the running task. Files are named by it, so no attempt touches another's; which files
    count is known from a table that Spark's committer wrote, one attempt of each task."""
    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId():x}"


def put(fs: pafs.FileSystem, path: str, data) -> None:
    with fs.open_output_stream(path, compression=None) as out:
        out.write(data)


def named(column: str) -> Column:
    """The column of exactly this name, with dots and backticks."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that begins so and that df does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for k in range(len(taken) + 1) if (n := name + "_" * k) not in taken)


def id_text(column: str) -> Column:
    """The id as text, null as the empty text."""
    return F.coalesce(named(column).cast("string"), F.lit(""))


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(id_text(column)), F.lit(parts))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def portions(batches: Iterator[pa.RecordBatch], column: str, chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about so many bytes of text at most (a longer text stands alone), and their texts, null as
    empty. Only one slice's texts are Python's at a time; in the end the worker, which lives on, gives its memory back."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(ends):
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + chars, "right")))
            part = batch.slice(first, last - first)
            yield part, [x or "" for x in part.column(column).to_pylist()]
            first = last
        del batch
    give_back()


def give_back() -> None:
    """A worker, which lives on after its task, gives free memory back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def constants(values: list, kind: str) -> Column:
    """The numbers as one array literal: Spark folds it once, where an array of a thousand literals slows its planner."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def block_of(column: str, width: int = BLOCK) -> Column:
    """The integer divided by width, rounded down."""
    return F.expr(f"(`{column}` - pmod(`{column}`, {width})) div {width}").cast("long")


def with_blocks(df: DataFrame, id_col: str, tie: Column, out: str, width: int = BLOCK) -> DataFrame:
    """df with a block number (long) that ascends with the integer id, about `width` rows a block whatever the ids are:
    dense, hashed over 63 bits, or in bursts.

    COARSE ranges of about equal counts are cut at the ids' approximate percentiles; each is cut into equal ranges of
    ids, as many as its rows need. Where a range holds more than LONG_RANGE blocks, its ids can lie so unevenly that this fails, so every
    range is first cut at its own percentiles into up to COARSE parts (`_finer`): a block holds about a 2^20th of all rows
    at most, beside `width`. Only the coarse ranges (lowest, highest id and count of each) reach the driver. Rows of one
    id stay in one block, but those without an id, which come before all, are cut by `tie`: an integer from 0 to 4095
    that ascends with the order in which they stand."""
    id_ = named(id_col).cast("long")
    ids = df.where(id_.isNotNull()).select(id_.alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [k / COARSE for k in range(1, COARSE)], 10 * COARSE)).first()[0] or [0] * (COARSE - 1)
    borders = constants(cuts, "bigint")
    coarse = lambda value: _place(borders, value, COARSE)
    base, low, factor, most = ([0] * COARSE, [0] * COARSE, [0.0] * COARSE, [0] * COARSE)
    blocks = largest_count = 0
    for k, least, largest, n in ids.groupBy(coarse(F.col("id"))).agg(F.min("id"), F.max("id"), F.count("*")).orderBy(F.col("min(id)")).collect():
        parts = -(-n // width)
        base[k], low[k], factor[k], most[k] = blocks, least, parts / (largest - least + 1), parts - 1
        blocks, largest_count = blocks + parts, max(largest_count, n)
    if largest_count > LONG_RANGE * width:
        return _finer(df, ids, id_, coarse, tie, out, width, largest_count)
    base_, low_, factor_, most_ = constants(base, "bigint"), constants(low, "bigint"), constants(factor, "double"), constants(most, "bigint")
    number = let(coarse(id_), lambda k: F.get(base_, k) + F.least(F.floor(_beyond(id_, F.get(low_, k)) * F.get(factor_, k)), F.get(most_, k)))
    # Never null, and known to be: a join on it then asks no filter of one side, and both sides can share an exchange.
    return df.withColumn(out, F.coalesce(F.when(id_.isNull(), tie - 4096).otherwise(number), F.lit(0)).cast("long"))


def _place(borders: Column, value: Column, parts: int) -> Column:
    """How many borders, of parts - 1 ascending ones (parts a power of two), are not above the value, by halving."""
    steps = [parts >> (k + 1) for k in range(parts.bit_length() - 1)]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when(F.get(borders, at + s - 1) <= value, at + s).otherwise(at)) if steps else F.lit(0)


def _beyond(id_: Column, low: Column) -> Column:
    return (id_.cast("decimal(20,0)") - low.cast("decimal(20,0)")).cast("double")


def _finer(df: DataFrame, ids: DataFrame, id_: Column, coarse, tie: Column, out: str, width: int, largest: int) -> DataFrame:
    """The blocks by ranges within ranges. The table of all of them, COARSE rows of arrays of up to COARSE numbers, is broadcast."""
    parts = min(COARSE, 1 << (-(-largest // width) - 1).bit_length())
    cuts = ids.groupBy(coarse(F.col("id")).alias("kg_k")).agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 4 * parts).alias("kg_cuts"))
    cuts = staged(cuts, "ranges")
    inside = ids.withColumn("kg_k", coarse(F.col("id"))).join(F.broadcast(cuts), "kg_k").groupBy("kg_k", _place(F.col("kg_cuts"), F.col("id"), parts).alias("s")).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    many = F.ceil(F.col("n") / width)
    before = Window.partitionBy("kg_k").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    facts = inside.select("kg_k", "s", F.coalesce(F.sum(many).over(before), F.lit(0)).alias("base"), "low", (many / (_beyond(F.col("high"), F.col("low")) + 1)).alias("factor"), (many - 1).alias("most"), many.alias("blocks"))
    names = ("base", "low", "factor", "most")
    by = facts.groupBy("kg_k").agg(F.sum("blocks").alias("kg_blocks"), F.map_from_entries(F.collect_list(F.struct("s", F.struct(*names)))).alias("kg_m"))
    by = by.withColumn("kg_start", F.coalesce(F.sum("kg_blocks").over(Window.orderBy("kg_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by = staged(by.join(cuts, "kg_k").select(F.col("kg_k").alias("kg_range"), "kg_start", "kg_cuts", F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.try_element_at("kg_m", k)).alias("kg_parts")), "blocks")
    met = df.withColumn("kg_here", coarse(id_)).join(F.broadcast(by), F.col("kg_here") == F.col("kg_range"), "left")
    inner = let(F.get("kg_parts", _place(F.col("kg_cuts"), id_, parts)), lambda p: p["base"] + F.least(F.floor(_beyond(id_, p["low"]) * p["factor"]), p["most"]))
    number = F.col("kg_start") + inner
    return met.withColumn(out, F.coalesce(F.when(id_.isNull(), tie - 4096).otherwise(number), F.lit(0)).cast("long")).drop("kg_here", "kg_range", "kg_start", "kg_cuts", "kg_parts")


def next_blocks(blocks: DataFrame, block: str) -> DataFrame:
    """From distinct blocks: (block, kg_next), the next larger one; after the largest the smallest, a null block before all.

    Groups of 1024 blocks are ordered in themselves; only the groups, one for about a quarter of a million documents, meet
    in one task."""
    rows = blocks.withColumn("kg_group", block_of(block, 1024))
    inside = Window.partitionBy("kg_group").orderBy(F.asc_nulls_first(block))
    here = F.struct(F.col(block).alias("b"))
    rows = rows.select(block, "kg_group", F.lead(here).over(inside).alias("kg_lead"))
    heads = blocks.withColumn("kg_g", block_of(block, 1024)).groupBy("kg_g").agg(F.min(here).alias("kg_head"))
    ring = Window.orderBy(F.asc_nulls_first("kg_g"))
    heads = heads.select("kg_g", F.lead("kg_head").over(ring).alias("kg_after"), F.first("kg_head").over(ring).alias("kg_start"))
    joined = rows.join(heads, F.col("kg_group").eqNullSafe(F.col("kg_g")))
    return joined.select(block, F.coalesce("kg_lead", "kg_after", "kg_start")["b"].alias("kg_next"))


def running_starts(counts: DataFrame, block: str, size: str) -> DataFrame:
    """From (block, size), one row a block: adds `base`, the sum of size over all smaller blocks (null first).

    Windows run inside groups of 1024 blocks; only the groups' totals, one row for about a quarter of a million
    documents, meet in one task."""
    rows = counts.withColumn("_group", block_of(block, 1024))
    inside = Window.partitionBy("_group").orderBy(F.asc_nulls_first(block)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    totals = rows.groupBy("_group").agg(F.sum(size).alias("_total"))
    before = Window.orderBy(F.asc_nulls_first("_group")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_group").alias("_g"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return rows.join(totals, F.col("_group").eqNullSafe(F.col("_g"))).withColumn("base", (F.col("_before") + F.col("_within")).cast("long")).drop("_group", "_g", "_within", "_before")
