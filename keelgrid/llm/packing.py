"""Packs examples into fixed-length training sequences: vector bin packing under limits on tokens, segments and loss tokens.

Each example is a vector (tokens, 1 segment, loss-bearing tokens). An example longer than a sequence is first cut into
full pieces; what remains waits in a pool. An open sequence takes, again and again, the waiting piece that fits and whose
vector has the largest dot product with the room left (both as shares of the limits). When nothing fits, the best piece is
cut so that the sequence is full, unless less than `least` tokens are free. The loss-bearing tokens are the last `loss` of
an example (a prompt comes before its answer). The last open sequence of a partition is taken apart into sequences whose
lengths are powers of two, so that it has no padding.

Partitions are packed apart from each other: nothing is shuffled, the pool has a fixed size, and a task that runs again
packs the same rows. A hot source or long text changes nothing.

Null and empty texts are examples of the end id alone. A null id stays null. Repeated rows are separate examples. Other
columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from keelgrid.llm.shared import named, portions
from keelgrid.llm.tokens import encoder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY, SEGMENTS, POOL, LEAST = 1024, 64, 1024, 8


class VectorPacker:
    """Places examples that come one by one. add() and finish() return placements:
    (example, start in it, length, loss tokens, sequence, offset in the sequence)."""

    def __init__(self, tokens: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None, pool: int = POOL, least: int = LEAST):
        self.limit = np.array([tokens, segments, loss or tokens], float)
        if min(self.limit) < 1:
            raise ValueError("each limit must be 1 at least")
        self.tokens, self.pool, self.least = tokens, pool, least
        self.key: list = []
        self.vector = np.zeros((pool + 1, 3))
        self.from_, self.whole_loss = np.zeros(pool + 1, np.int64), np.zeros((pool + 1, 2), np.int64)
        self.count = self.sequence = 0
        self.open: list[tuple] = []
        self.room = self.limit.copy()
        self.out: list[tuple] = []

    def add(self, key, length: int, loss: int) -> list[tuple]:
        at, quiet = 0, length - loss
        lost = lambda a, b: max(0, b - max(a, quiet))
        while length - at > self.tokens or lost(at, length) > self.limit[2]:
            n = self._prefix(at, length - at, quiet, self.limit)
            self._close([(key, at, n, lost(at, at + n))])
            at += n
        if length - at == self.tokens:
            self._close([(key, at, length - at, lost(at, length))])
        elif length > at:
            self._wait(key, at, length - at, quiet)
            while self.count >= self.pool:
                self._fill()
        return self._taken()

    def finish(self) -> list[tuple]:
        while self.count:
            self._fill()
        self._split()
        return self._taken()

    def _taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def _wait(self, key, start: int, n: int, quiet: int) -> None:
        i = self.count
        self.key.append(key)
        self.vector[i] = n, 1, max(0, start + n - max(start, quiet))
        self.from_[i], self.whole_loss[i] = start, (quiet, n)
        self.count += 1

    def _remove(self, i: int) -> None:
        self.count = last = self.count - 1
        self.key[i] = self.key[last]
        self.key.pop()
        for a in (self.vector, self.from_, self.whole_loss):
            a[i] = a[last]

    @staticmethod
    def _prefix(start: int, n: int, quiet: int, room: np.ndarray) -> int:
        """Tokens from start that fit the room."""
        return int(min(n, room[0], max(0, quiet - start) + room[2]))

    def _put(self, key, start: int, n: int, loss: int) -> None:
        self.open.append((key, start, n, loss))
        self.room -= (n, 1, loss)

    def _fill(self) -> None:
        """Puts one piece into the open sequence, or closes it."""
        v = self.vector[: self.count]
        gain = (v / self.limit) @ (self.room / self.limit)
        fits = (v <= self.room).all(axis=1)
        if fits.any():
            i = int(np.argmax(np.where(fits, gain, -1)))
            self._put(self.key[i], int(self.from_[i]), int(v[i, 0]), int(v[i, 2]))
            self._remove(i)
            if self.room[0] == 0:
                self._close(self.open)
            return
        if self.room[0] >= self.least and self.room[1] >= 1:
            i = int(np.argmax(gain))
            start, (quiet, n) = int(self.from_[i]), self.whole_loss[i].tolist()
            if (took := self._prefix(start, n, quiet, self.room)) >= self.least:
                key = self.key[i]
                self._put(key, start, took, max(0, start + took - max(start, quiet)))
                self._remove(i)
                self._wait(key, start + took, n - took, quiet)
                if self.room[0] == 0:
                    self._close(self.open)
                    return
        if self.room[0] < self.least:
            self._close(self.open)
        else:
            self._split()

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, n, loss in pieces:
            self.out.append((key, start, n, loss, self.sequence, offset))
            offset += n
        self.sequence += 1
        if pieces is self.open:
            self.open, self.room = [], self.limit.copy()

    def _split(self) -> None:
        """Closes the open sequence as sequences whose lengths are powers of two."""
        pieces, self.open, self.room = self.open[::-1], [], self.limit.copy()
        left = sum(p[2] for p in pieces)
        while left:
            want = size = 1 << (left.bit_length() - 1)
            now = []
            while want:
                key, start, n, loss = pieces.pop()
                if n > want:
                    pieces.append((key, start + want, n - want, min(loss, n - want)))
                    loss, n = max(0, loss - (n - want)), want
                now.append((key, start, n, loss))
                want -= n
            self._close(now)
            left -= size


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = 0, tokens: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None, with_ids: bool = False, prompt_col: str | None = None) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset, and with_ids the ids
    (little-endian unsigned 32-bit). Every token of a document bears loss. With prompt_col (instruction data) an example is
    the ids of the prompt, of the text and the end id, and only the last two bear loss; `loss` then limits them apart from
    the tokens."""
    kind = df.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset"))]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first, ids = VectorPacker(tokens, segments, loss), TaskContext.get().partitionId() << 32, pa.array([])

        def rows(placed: list[tuple]) -> pa.RecordBatch:
            keys = [p[0] for p in placed]
            pieces = [k[1][4 * p[1] : 4 * (p[1] + p[2])] for k, p in zip(keys, placed, strict=True)]
            columns = [pa.array([k[0] for k in keys], ids.type)]
            columns += [pa.array(x, pa.int64()) for x in ([p[1] for p in placed], [p[2] for p in placed], [zlib.crc32(x) for x in pieces], [len(k[1]) // 4 for k in keys], [p[3] for p in placed], [first + p[4] for p in placed], [p[5] for p in placed])]
            return pa.RecordBatch.from_arrays(columns + [pa.array(pieces, pa.binary())] * with_ids, names=schema.names)

        for part, texts in portions(batches, "kg_text"):
            ids, placed = part.column(0), []
            prompts = encoder(vocabulary).encode([x or "" for x in part.column(2).to_pylist()]) if prompt_col else [b""] * len(texts)
            for key, before, raw in zip(ids.to_pylist(), prompts, encoder(vocabulary).encode(texts), strict=True):
                n = len(raw) // 4 + 1
                placed += packer.add((key, before + raw + end), len(before) // 4 + n, n)
            if placed:
                yield rows(placed)
        if placed := packer.finish():
            yield rows(placed)

    return df.select(named(id_col).alias("kg_id"), named(text_col).alias("kg_text"), *(named(c).alias("kg_prompt") for c in [prompt_col] if c)).mapInArrow(run, schema)
