"""Hard negatives for contrastive training: exact inner-product search in ball trees, branch and bound from both sides.

A row is an id (integer), a vector and a label. Components become floor(scale * x), so scores (inner products) are exact
integers. An anchor's positives are its first `positives` other rows of the same label; for each, its negatives are the
first `negatives` rows of another label whose score lies in the window low * p <= 100 * s <= high * p, p being the
positive's score. Higher scores come first, ties by the smaller id. Anchors with fewer positives or negatives give fewer
rows; a negative p has an empty window.

Every task cuts its rows into trees of TREE_BYTES: a node splits between labels where it holds several, else across its
farthest points, and keeps its centre, radius and range of labels. |<a, x> - <a, centre>| <= |a| * radius bounds the scores in a
node above and below, so a node is left out whose scores all lie outside the window or strictly beneath the current
last of the anchor's best (equal ones may hold a smaller id). The trees are a written table. Anchors go to them in blocks of
BLOCK_BYTES, broadcast one after the other; each task takes a block through its trees and keeps each anchor's best, and
only those are shuffled. All anchors meet all rows in this way unless the bounds spare it: the search is exact.

Rows take no part whose id, label or vector is null, or that have a null or non-finite component, or whose squared length
after scaling passes 2^62 (scores would leave 64 bits). Of rows with one id that of the smallest (label, vector) stands,
so repeated rows count once. Shorter vectors are filled up with zeros; an empty vector scores 0 with all. Labels compare as
64-bit integers. Other columns, whatever their names, are ignored. An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelgrid.llm.shared import named, shared_folder, staged

POSITIVES, NEGATIVES, LOW, HIGH, SCALE, EVERY = 5, 3, 50, 95, 256, 50
TREE_BYTES, LEAF, BLOCK_BYTES = 1 << 20, 128, 16 << 20
#: Less than any score; it and its opposite are 64-bit integers.
_NONE = -(1 << 63) + 2
_SCHEMA = T.StructType([T.StructField("anchor_id", T.LongType()), T.StructField("positive_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("negative_id", T.LongType()), T.StructField("positive_score", T.LongType()), T.StructField("negative_score", T.LongType())])


def taking_part(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vector) of the rows that take part, one an id."""
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold integers")
    rows = df.select(named(id_col).cast("long").alias("id"), named(label_col).cast("long").alias("label"), named(vector_col).cast("array<double>").alias("vector")).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.pow(F.floor(F.lit(float(scale)) * x).cast("double"), F.lit(2.0)))
    rows = rows.where(finite).where(length <= float(1 << 62))
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("kg_row")).select("id", "kg_row.label", "kg_row.vector")


def _matrix(vectors: pa.Array, scale: int) -> np.ndarray:
    """Scaled integers, one row a vector, shorter ones filled with zeros."""
    ends = np.append(0, np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False)))
    size = np.diff(ends)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(ends[-1]) - ends[row]] = np.floor(float(scale) * vectors.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
    return out


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x.astype(float), x.astype(float)))


class Tree:
    """Rows in the order of the tree's leaves, and its nodes in preorder: a node's rows, its right child (0 for a leaf; the left is the
    next node), centre, radius, and the least and greatest label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids, labels))
        x = vectors.astype(float)
        nodes: list[list] = []
        stack = [(0, len(ids), -1)]
        while stack:
            a, b, parent = stack.pop()
            if parent >= 0:
                nodes[parent][2] = len(nodes)
            rows = order[a:b]
            centre = x[rows].mean(axis=0)
            away = _lengths(x[rows] - centre)
            low, high = int(labels[rows[0]]), int(labels[rows[-1]])
            nodes.append([a, b, 0, centre, float(away.max()), low, high])
            if b - a <= leaf:
                continue
            if low != high:
                steps = np.flatnonzero(np.diff(labels[rows])) + 1
                cut = int(steps[np.argmin(np.abs(steps - (b - a) // 2))])
            else:
                one = x[rows[away.argmax()]]
                other = x[rows[_lengths(x[rows] - one).argmax()]]
                cut = (b - a) // 2
                order[a:b] = rows[np.argpartition((x[rows] - one) @ (other - one), cut)]
            here = len(nodes) - 1
            stack += [(a + cut, b, here), (a, a + cut, -1)]
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.first, self.last, self.right, self.low, self.high = (np.array([n[k] for n in nodes], np.int64) for k in (0, 1, 2, 5, 6))
        self.centre, self.radius = np.array([n[3] for n in nodes]).reshape(len(nodes), -1), np.array([n[4] for n in nodes])

    PARTS = ("ids", "labels", "vectors", "first", "last", "right", "low", "high", "centre", "radius")

    def packed(self) -> dict:
        return {k: getattr(self, k).tobytes() for k in self.PARTS}

    @classmethod
    def unpacked(cls, row: dict) -> Tree:
        self = cls.__new__(cls)
        for k in cls.PARTS:
            setattr(self, k, np.frombuffer(row[k], float if k in ("centre", "radius") else np.int64))
        self.vectors, self.centre = self.vectors.reshape(len(self.ids), -1), self.centre.reshape(len(self.first), -1)
        return self


class Search:
    """A block of anchors with windows of scores (anchors x slots), and the best `keep` rows of each so far.

    same: look among rows of the anchor's label, without its own id, or among those of other labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int, same: bool):
        self.ids, self.labels, self.vectors, self.low, self.high, self.keep, self.same = ids, labels, vectors, low, high, keep, same
        self.length = _lengths(vectors)
        self.floats = vectors.astype(float)
        self.score = np.full((*low.shape, keep), _NONE)
        self.found = np.full((*low.shape, keep), np.iinfo(np.int64).max)
        self.compared = 0

    def _dot(self, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        d = min(vectors.shape[1], self.vectors.shape[1])
        if self.length[at].max() * _lengths(vectors).max() < 2**53:
            return (self.floats[at, :d] @ vectors[:, :d].T.astype(float)).astype(np.int64)
        return self.vectors[at, :d] @ vectors[:, :d].T

    def _bounds(self, tree: Tree, node: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Below and above, with room for rounding."""
        centre = tree.centre[node]
        d = min(len(centre), self.vectors.shape[1])
        middle = self.floats[at, :d] @ centre[:d]
        room = self.length[at] * (tree.radius[node] + 1e-9 * (np.sqrt(centre @ centre) + tree.radius[node])) + 1
        return middle - room, middle + room

    def through(self, tree: Tree) -> None:
        stack = [(0, np.arange(len(self.ids)))] if len(self.ids) else []
        while stack:
            node, at = stack.pop()
            low, high = tree.low[node], tree.high[node]
            if self.same:
                at = at[(self.labels[at] >= low) & (self.labels[at] <= high)]
            elif low == high:
                at = at[self.labels[at] != low]
            if not len(at):
                continue
            below, above = self._bounds(tree, node, at)
            last = np.maximum(self.low[at], self.score[at, :, -1])
            at = at[((above[:, None] >= last) & (below[:, None] <= self.high[at])).any(axis=1)]
            if not len(at):
                continue
            if not tree.right[node]:
                self._leaf(tree, node, at)
                continue
            left, right = node + 1, int(tree.right[node])
            # Each anchor goes first where its scores can be larger.
            first = self._bounds(tree, left, at)[1] >= self._bounds(tree, right, at)[1]
            stack += [(right, at[first]), (left, at[first]), (left, at[~first]), (right, at[~first])]

    def _leaf(self, tree: Tree, node: int, at: np.ndarray) -> None:
        rows = slice(int(tree.first[node]), int(tree.last[node]))
        ids, labels = tree.ids[rows], tree.labels[rows]
        scores = self._dot(at, tree.vectors[rows])
        self.compared += scores.size
        alike = self.labels[at][:, None] == labels[None]
        may = alike & (self.ids[at][:, None] != ids[None]) if self.same else ~alike
        for slot in range(self.low.shape[1]):
            least = np.maximum(self.low[at, slot], self.score[at, slot, -1])
            a, r = np.nonzero(may & (scores >= least[:, None]) & (scores <= self.high[at, slot][:, None]))
            if len(a):
                self._merge(slot, at[a], scores[a, r], ids[r])

    def _merge(self, slot: int, anchor: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        some = np.unique(anchor)
        anchor = np.concatenate([anchor, np.repeat(some, self.keep)])
        score = np.concatenate([score, self.score[some, slot].ravel()])
        found = np.concatenate([found, self.found[some, slot].ravel()])
        order = np.lexsort((found, -score, anchor))
        anchor, score, found = anchor[order], score[order], found[order]
        place = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
        best = place < self.keep
        self.score[anchor[best], slot, place[best]] = score[best]
        self.found[anchor[best], slot, place[best]] = found[best]

    def best(self) -> pa.RecordBatch:
        a, slot, k = np.nonzero(self.score > _NONE)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[a]), pa.array(slot.astype(np.int32)), pa.array(self.score[a, slot, k]), pa.array(self.found[a, slot, k])], names=["anchor_id", "slot", "score", "found"])


def trees(rows: DataFrame, scale: int = SCALE, tree_bytes: int = TREE_BYTES, leaf: int = LEAF) -> DataFrame:
    """From (id, label, vector): a written table of trees, one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = max(1, int(np.max(batch.column(2).value_lengths().to_numpy(zero_copy_only=False), initial=1)))
            many = max(1, tree_bytes // (8 * wide))
            for at in range(0, batch.num_rows, many):
                part = batch.slice(at, many)
                tree = Tree(part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), scale), leaf)
                yield pa.RecordBatch.from_pylist([tree.packed()])

    return staged(rows.select("id", "label", "vector").mapInArrow(run, ", ".join(f"{k} binary" for k in Tree.PARTS)), "trees")


def _first(df: DataFrame, keep: int) -> DataFrame:
    """The first of each anchor and slot over all tasks, with their rank."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "found")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _searched(index: DataFrame, block: tuple, low: np.ndarray, high: np.ndarray, keep: int, same: bool) -> DataFrame:
    """(anchor_id, slot, score, found): each task's best. One block, bounded by BLOCK_BYTES, is broadcast."""
    shared = index.sparkSession.sparkContext.broadcast((*block, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*shared.value, keep, same)
        for batch in batches:
            for k in range(batch.num_rows):
                search.through(Tree.unpacked({name: batch.column(i)[k].as_buffer() for i, name in enumerate(Tree.PARTS)}))
        yield search.best()

    return index.mapInArrow(run, "anchor_id long, slot int, score long, found long")


def hard_negatives(
    df: DataFrame, anchors: Callable[[Column], Column], id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    tree_bytes: int = TREE_BYTES, block_bytes: int = BLOCK_BYTES, leaf: int = LEAF,
) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score (long) for the rows whose id
    meets the condition `anchors`."""
    spark = df.sparkSession
    rows = taking_part(df, id_col, vector_col, label_col, scale)
    index = trees(rows, scale, tree_bytes, leaf)
    chosen = staged(rows.where(anchors(F.col("id"))), "anchors")
    count, wide = chosen.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-count * 8 * max(1, wide or 0) // block_bytes))
    folder = shared_folder(spark, "negatives")
    if blocks > 1:
        chosen.withColumn("kg_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition("kg_block").write.partitionBy("kg_block").parquet(f"{folder}/anchors")
        chosen = spark.read.parquet(f"{folder}/anchors")
    done = []
    for number in range(blocks if count else 0):
        own = (chosen.where(F.col("kg_block") == number) if blocks > 1 else chosen).select("id", "label", "vector").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        block = own.column(0).to_numpy(), own.column(1).to_numpy(), _matrix(own.column(2).combine_chunks(), scale)
        n = len(block[0])
        open_ = np.full((n, 1), _NONE + 1), np.full((n, 1), np.iinfo(np.int64).max)
        pairs = staged(_first(_searched(index, block, *open_, positives, True), positives).select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        windows = _windows(block[0], pairs.toArrow(), positives, low, high)
        found = _first(_searched(index, block, *windows, negatives, False), negatives).select(F.col("anchor_id").alias("a"), F.col("slot").alias("s"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
        path = f"{folder}/{number}"
        pairs.join(found, (F.col("anchor_id") == F.col("a")) & (F.col("slot") == F.col("s"))).select(*_SCHEMA.names).write.parquet(path)
        done.append(path)
    return spark.read.schema(_SCHEMA).parquet(*done) if done else spark.createDataFrame([], _SCHEMA)


def _windows(ids: np.ndarray, pairs: pa.Table, slots: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score by anchor and slot, in whole numbers; where there is no positive, a window that nothing meets."""
    least, most = np.full((len(ids), slots), 1), np.full((len(ids), slots), 0)
    place = {int(x): k for k, x in enumerate(ids)}
    for anchor, slot, score in zip(*(pairs.column(c).to_pylist() for c in ("anchor_id", "slot", "positive_score")), strict=True):
        least[place[anchor], slot], most[place[anchor], slot] = -(-low * score // 100), high * score // 100
    return least, most
