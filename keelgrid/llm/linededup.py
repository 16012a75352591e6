"""Removes repeated passages: overlapping windows of three lines, found over the whole table, later occurrences removed.

A window is three consecutive lines of a text, told by two 64-bit hashes of its lines. Of all places that have the same
window the first (smallest id, null before all; then smallest text hash; then smallest line) stays; all lines that any
later place covers are removed, overlapping windows merged. Windows of spaces only do not count (op2's SQL says so; other
white space is text). A text of fewer than
three lines has no window and stays as it is, as op2's SQL says; with short=True (the pipeline) it is one window of all its
lines, which only texts of the same lines share. Null and empty texts stay as they are. Rows of equal id and equal text are one document:
they get the same text. The two
counts have the names that `counts` gives; columns of df of these names are replaced. An empty table gives an empty table.

Only hashes are shuffled to find the windows: partial minima meet, one row a window, so a passage in a third of all
documents is no hot task; the join back is a sort-merge join whose large partitions Spark splits. The texts are then
shuffled once, whole, and cut into lines after that; not at all where Spark finds the marks small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelgrid.llm.shared import let, named

LINES = 3


def _windows(lines: Column, size: int, short: bool = False) -> Column:
    """Array of (position, two hashes) of the windows that count; if short, of fewer lines one of them all."""
    first = F.transform(lines, lambda x: F.xxhash64(x))
    second = F.transform(lines, lambda x: F.xxhash64(x, F.lit(1)))
    blank = F.transform(lines, lambda x: F.trim(x) == "")

    def of(h: Column) -> Column:
        take = lambda k, i: [h[k][i + j] for j in range(size)]
        every = F.transform(
            F.sequence(F.lit(0), F.size(h["a"]) - size),
            lambda i: F.struct(i.cast("int").alias("pos"), F.xxhash64(*take("a", i)).alias("h1"), F.xxhash64(*take("b", i), F.lit(2)).alias("h2"), F.forall(F.array(*take("blank", i)), lambda x: x).alias("blank")),
        )
        found = F.when(F.size(h["a"]) >= size, F.filter(every, lambda w: ~w["blank"]))
        if not short:
            return found
        fold = lambda k: F.aggregate(h[k], F.size(h[k]).cast("long"), lambda a, x: F.xxhash64(a, x))
        whole = F.struct(F.lit(0).alias("pos"), fold("a").alias("h1"), fold("b").alias("h2"), F.forall(h["blank"], lambda x: x).alias("blank"))
        return found.otherwise(F.filter(F.array(whole), lambda w: ~w["blank"]))

    return let(F.struct(first.alias("a"), second.alias("b"), blank.alias("blank")), of)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = LINES, short: bool = False, counts: tuple[str, str] = ("line_count", "removed_lines")) -> DataFrame:
    """All rows and columns of df, the text without later occurrences, and the numbers of its lines and of those removed (long)."""
    text = named(text_col)
    key, cut = F.xxhash64(text), lambda x: F.split(x, "\n", -1)
    may = text.isNotNull() if short else text.contains("\n")
    places = df.where(may).select(named(id_col).alias("kg_id"), key.alias("kg_key"), cut(text).alias("kg_lines"))
    places = places.select("kg_id", "kg_key", F.explode(_windows(F.col("kg_lines"), size, short)).alias("kg_w")).select("kg_id", "kg_key", "kg_w.pos", "kg_w.h1", "kg_w.h2")
    first = places.groupBy("h1", "h2").agg(F.min(F.struct("kg_id", "kg_key", "pos")).alias("kg_first"), F.count("*").alias("kg_n")).where("kg_n > 1").select(F.col("h1").alias("kg_h1"), F.col("h2").alias("kg_h2"), "kg_first")
    own = F.struct("kg_id", "kg_key", "pos")
    later = places.join(first, (F.col("h1") == F.col("kg_h1")) & (F.col("h2") == F.col("kg_h2"))).where(~own.eqNullSafe(F.col("kg_first")))
    marks = later.groupBy("kg_id", "kg_key").agg(F.array_sort(F.collect_set("pos")).alias("kg_marks"))
    return _removed(df, marks, id_col, text_col, key, cut, size, counts)


def _removed(df: DataFrame, marks: DataFrame, id_col: str, text_col: str, key: Column, cut, size: int, counts: tuple[str, str]) -> DataFrame:
    names = [c for c in df.columns if c.lower() not in counts]
    rest = [c for c in names if c not in (id_col, text_col)]
    rows = df.select(named(id_col).alias("own_id"), key.alias("own_key"), named(text_col).alias("own_text"), F.struct(F.lit(0).alias("none"), *(named(c).alias(f"c{i}") for i, c in enumerate(rest))).alias("own_rest"))
    joined = rows.join(marks, F.col("own_id").eqNullSafe(F.col("kg_id")) & (F.col("own_key") == F.col("kg_key")), "left").withColumn("kg_lines", cut(F.col("own_text")))
    # Marks are ascending: between two marks the lines that stay form one slice, so that a text is cut in one pass.
    ends = lambda m: F.concat(m, F.array(F.size("kg_lines")))
    starts = lambda m: F.concat(F.array(F.lit(0)), F.transform(m, lambda p: p + size))
    pieces = let(
        F.struct(starts(F.col("kg_marks")).alias("a"), ends(F.col("kg_marks")).alias("b")),
        lambda s: F.flatten(F.transform(F.arrays_zip(s["a"], s["b"]), lambda x: F.slice(F.col("kg_lines"), x["a"] + 1, F.greatest(x["b"] - x["a"], F.lit(0))))),
    )
    done = joined.withColumn("kg_kept", F.when(F.col("kg_marks").isNotNull(), pieces).otherwise(F.col("kg_lines")))
    text = F.when(F.col("kg_marks").isNull(), F.col("own_text")).otherwise(F.array_join("kg_kept", "\n"))
    whole = F.when(F.col("own_text").isNull(), F.lit(0)).otherwise(F.size("kg_lines")).cast("long")
    value = {id_col: F.col("own_id"), text_col: text} | {c: F.col(f"own_rest.c{i}") for i, c in enumerate(rest)}
    return done.select(*(value[c].alias(c) for c in names), whole.alias(counts[0]), F.when(F.col("kg_marks").isNull(), F.lit(0)).otherwise(whole - F.size("kg_kept")).cast("long").alias(counts[1]))
