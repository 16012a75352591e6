"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents: each segment holds, for some documents, every word's postings (ascending token positions),
and is one row of a written table, so a search needs no shuffle and no posting list is longer than its segment. A
frequent word, a hot source or a passage that many documents share is spread like the documents are. A phrase is found
from its rarest word in the segment: its positions, less the word's offset, are possible starts; they are intersected with
the offset-adjusted postings of the other words, next rarest first. With `slop` above 0 a document is also near an item if
for some place p it has every word j of a window at most `slop` from p + j (proximity); places are sought around each
posting of the rarest word, and documents stand so far apart that no place has words of two. How the documents are cut
into segments changes no result.

A-Z are lower-cased; words are runs of digits, letters and all characters beyond ASCII. A window is `size` consecutive
words of an item; an item with fewer, but not none, is one window. Null and empty texts have no words. Items go out in
blocks of at most BLOCK_WORDS words (a larger item alone), so what is sent to the executors is bounded. A match never
reaches from one document into the next. Rows of one doc_id are judged apart. A null item_id counts among the items as
the text `null`. Other columns are ignored; empty tables give no rows, or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelgrid.llm.features import _LOWER, word_spans
from keelgrid.llm.shared import named, portions, staged

SIZE, SEGMENT_CHARS, BLOCK_WORDS = 13, 3_000_000, 200_000
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (binary), and how many each text has."""
    pieces = [x.encode("utf-8", "replace") + b"\n" for x in texts]
    raw = _LOWER[np.frombuffer(b"".join(pieces), np.uint8)]
    inside = _WORD[raw]
    starts, ends = word_spans(raw, inside)
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[inside]))])
    stops = np.cumsum([len(x) for x in pieces])
    return words, np.diff(np.searchsorted(starts, np.append(0, stops)))


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index. A segment's row: documents and their word counts, words, where each word's postings end, and
    the postings as differences. Between two documents one position is left free."""
    kind = df.schema[id_col].dataType.simpleString()
    df = df.select(named(id_col).alias("kg_id"), named(text_col).alias("kg_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, (part, texts) in enumerate(portions(batches, "kg_text", SEGMENT_CHARS)):
            words, counts = words_of(texts)
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy()
            order = np.argsort(codes.astype(np.uint32), kind="stable")
            place = np.arange(len(codes)) + np.repeat(np.arange(len(counts)), counts)
            ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary))) if len(codes) else np.zeros(0, np.int64)
            postings = np.diff(place[order], prepend=0).astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + number]), pa.array([part.column(0).to_pylist()], pa.list_(part.schema.field(0).type)), pa.array([counts.astype(np.int32)], pa.list_(pa.int32())), pa.array([coded.dictionary], pa.list_(pa.binary())), pa.array([ends.astype("<i4").tobytes()], pa.binary()), pa.array([postings.tobytes()], pa.binary())],
                names=["segment", "docs", "counts", "words", "ends", "postings"],
            )

    return staged(df.mapInArrow(run, f"segment long, docs array<{kind}>, counts array<int>, words array<binary>, ends binary, postings binary"), "index")


class Queries:
    """Windows of items, as arrays of word numbers (-1 beyond a shorter item's end)."""

    def __init__(self, items: list[tuple[object, str]], size: int = SIZE):
        words, counts = words_of([t for _, t in items])
        coded = words.dictionary_encode()
        self.words, codes = coded.dictionary, coded.indices.to_numpy()
        found: dict[tuple[int, ...], set[int]] = {}
        self.ids, at = [], 0
        for (name, _), n in zip(items, counts.tolist(), strict=True):
            own = codes[at : at + n].tolist()
            at += n
            if n:
                self.ids.append(name)
                for i in range(max(1, n - size + 1)):
                    found.setdefault(tuple(own[i : i + size]), set()).add(len(self.ids) - 1)
        self.windows = np.full((len(found), size), -1, np.int64)
        for row, w in zip(self.windows, found, strict=True):
            row[: len(w)] = w
        self.items = [sorted(x) for x in found.values()]


def search_segment(queries: Queries, words: pa.Array, ends: np.ndarray, postings: np.ndarray, slop: int = 0) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each window that occurs: its number, its length, the starts (token positions in the segment; with slop the
    places around which it lies)."""
    if not len(queries.windows) or not len(words):
        return
    here = pc.index_in(queries.words, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
    begins = np.append(0, ends[:-1])
    used = queries.windows >= 0
    local = np.where(used, here[queries.windows], 0)
    possible = np.flatnonzero(((local >= 0) | ~used).all(axis=1))
    df = ends - begins
    for k in possible.tolist():
        n = int(used[k].sum())
        own = local[k, :n]
        starts = None
        for j in np.argsort(df[own], kind="stable").tolist():
            adjusted = postings[begins[own[j]] : ends[own[j]]] - j
            if starts is None:
                starts = np.unique(adjusted[:, None] + np.arange(-slop, slop + 1)) if slop else adjusted
                continue
            i = np.searchsorted(adjusted, starts)
            if slop:
                after = np.abs(adjusted[np.minimum(i, len(adjusted) - 1)] - starts)
                before = np.abs(adjusted[np.maximum(i - 1, 0)] - starts)
                starts = starts[np.minimum(after, before) <= slop]
            else:
                starts = starts[adjusted[np.minimum(i, len(adjusted) - 1)] == starts]
            if not len(starts):
                break
        if len(starts):
            yield k, n, starts


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_WORDS) -> Iterator[list[tuple[object, str]]]:
    """The items with words, block by block, in the order of their ids; one block is on the driver at a time."""
    block, held = [], 0
    rows = items.select(named(id_col).alias("id"), named(text_col).alias("text")).where("text is not null").orderBy("id", "text")
    for name, text in rows.toLocalIterator():
        n = text.count(" ") + text.count("\n") + 1
        if block and held + n > most:
            yield block
            block, held = [], 0
        block.append((name, text))
        held += n
    yield block


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = SIZE, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each document: segment and place there, id (doc), n_words, n_hit (words inside any exact match), the spans of word
    positions that exact matches cover (start, end), the ids (as text) of items with an exact match, and with slop of those
    with a proximity match. Several blocks of items give overlapping spans, which are merged for n_hit only."""
    kind = index.schema["docs"].dataType.elementType.simpleString()
    found, number = None, 0
    for block in item_blocks(items, item_col, text_col, block_words):
        queries = Queries(block, size)

        def run(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    yield _judged(queries, *(batch.column(k)[row] for k in range(6)), slop)

        one = index.mapInArrow(run, f"segment long, doc {kind}, place int, n_words long, spans array<struct<start:int,end:int>>, items array<string>, near array<string>")
        found, number = one if found is None else found.unionByName(one), number + 1
    if number > 1:
        gathered = lambda c: F.flatten(F.collect_list(c))
        found = found.groupBy("segment", "place").agg(F.first("doc").alias("doc"), F.max("n_words").alias("n_words"), gathered("spans").alias("spans"), F.array_distinct(gathered("items")).alias("items"), F.array_distinct(gathered("near")).alias("near"))
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))))
    hit = F.size(places) if number > 1 else F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return found.select("segment", "place", "doc", "n_words", hit.cast("long").alias("n_hit"), "spans", "items", "near")


def _judged(queries: Queries, segment, docs, counts, words, ends, postings, slop: int) -> pa.RecordBatch:
    counts, ends = counts.values.to_numpy().astype(np.int64), np.frombuffer(ends.as_py(), "<i4").astype(np.int64)
    places = np.cumsum(np.frombuffer(postings.as_py(), "<i4"), dtype=np.int64)
    first = np.cumsum(counts + 1) - counts - 1
    covered: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[int]] = {}
    near: dict[int, set[int]] = {}
    for k, n, starts in search_segment(queries, words.values, ends, places):
        of = np.searchsorted(first, starts, "right") - 1
        for d, s in zip(of.tolist(), (starts - first[of]).tolist(), strict=True):
            covered.setdefault(d, []).append((s, s + n))
            items.setdefault(d, set()).update(queries.items[k])
    if slop:
        gap = queries.windows.shape[1] + 2 * slop
        apart = places + gap * (np.searchsorted(first, places, "right") - 1)
        first = first + gap * np.arange(len(first))
        for k, _, starts in search_segment(queries, words.values, ends, apart, slop):
            for d in np.unique(np.searchsorted(first, starts + slop, "right") - 1).tolist():
                near.setdefault(d, set()).update(queries.items[k])
    spans = []
    for d in range(len(counts)):
        merged: list[list[int]] = []
        for a, b in sorted(set(covered.get(d, ()))):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        spans.append([{"start": a, "end": b} for a, b in merged])
    names = lambda found: pa.array([sorted({"null" if queries.ids[i] is None else str(queries.ids[i]) for i in found.get(d, ())}) for d in range(len(counts))], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(counts), segment.as_py())), docs.values, pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), names(items), names(near)],
        names=["segment", "doc", "place", "n_words", "spans", "items", "near"],
    )


def contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = SIZE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated (a hit word at least, and 5 % of the words)."""
    found = search(build_index(df, id_col, text_col), items, item_col, "text", size, 0, block_words)
    return found.select(
        F.col("doc").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
