"""Phrase collocations: count-min sketches find what can be frequent, a second pass counts that exactly, then scores and subsumes.

A-Z are lower-cased, texts are cut into pieces at `.,;:!?` and at line breaks (0A to 0D), pieces into words at spaces and
tabs. Everything is counted per language (null: `und`). Candidates are phrases of 2 to `max_words` words that occur `least`
times or more within pieces, overlaps included. A candidate's score is floor(1000000 * a * a / (l * r)) at its
lowest-scoring cut (ties: the smallest first part), a, l and r being the occurrences of the phrase and of its two parts. A
candidate that lies inside a longer one with at least `share` hundredths of its occurrences is dropped. The first `keep` of
each language stay: score, then a, both descending, then the phrase in byte order.

Every task has a sketch of its own, DEPTH rows of counters that stop at 255; the sketches are added block by block in a
shuffle. A sketch never says too little, so a phrase whose sum is below `least` somewhere is not frequent, and neither is
any phrase that holds it: words and pairs share the first sketch, each longer size has a sketch of its own, of only those
phrases whose two shorter parts passed. What goes to the workers is one bit a counter. The second pass counts words and
phrases that passed, by their strings; only these counts are shuffled, and what is not frequent after all goes there.

A row of a sketch has a counter for each 16 bytes of text, up to MAX_WIDTH, so a task's memory and what is broadcast are bounded
(DEPTH * MAX_WIDTH bytes, and an eighth of that). With more text than 16 * MAX_WIDTH bytes the sketch gets coarser: more
phrases are counted exactly that are not frequent, and nothing else changes. Give clusters with more memory a larger
`max_width`.

Null and empty texts hold no words. A language without words has no rows. Repeated rows count as often as they stand.
Very long texts, and very long words, are read in windows of WINDOW bytes. Other columns are ignored, whatever their
names. An empty table gives no rows. Products are decimals of 38 digits: exact up to 10^15 occurrences of a phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelgrid.llm.shared import give_back, named, staged

DEPTH, MIN_WIDTH, MAX_WIDTH, BLOCK = 2, 1 << 16, 1 << 25, 4096
LEAST, MAX_WORDS, SHARE, KEEP = 10, 3, 50, 2000
WINDOW, LONG, SALTS, HELD, MERGE = 1 << 20, 1024, 64, 1_500_000, 100_000
#: Partitions of the source that one task reads at most.
JOINED = 64

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_rng = np.random.default_rng(20)
#: Two 64-bit codes of each byte, the same for both cases of a letter, and an odd base for each.
_CODES = _rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_CODES[:, 65:91] = _CODES[:, 97:123]
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95)
_MIX, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC2B2AE3D27D4EB4F)
_ROWS = _rng.integers(0, 1 << 63, DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of the base modulo 2^64, at least n of them."""
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = np.concatenate([np.ones(1, np.uint64), np.full(n + n // 4, base, np.uint64)]).cumprod(dtype=np.uint64)
    return _POWERS[base]


def word_hashes(part: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """64-bit hashes of the words part[start:end], lower-cased: a polynomial of the bytes' codes, taken from running sums; of
    words longer than LONG the library's hash."""
    out = np.empty(len(start), np.uint64)
    base, at = _BASES[which], 0
    inverse = pow(base, -1, 1 << 64)
    for stop in [*np.flatnonzero(end - start > LONG).tolist(), len(start)]:
        if stop > at:  # the short words up to the next long one
            first, last = int(start[at]), int(end[stop - 1])
            sums = np.zeros(last - first + 1, np.uint64)
            np.cumsum(_CODES[which][part[first:last]] * _powers(base, last - first)[: last - first], out=sums[1:])
            a, b = start[at:stop] - first, end[at:stop] - first
            out[at:stop] = _mixed((sums[b] - sums[a]) * _powers(inverse, last - first)[a] + (b - a).astype(np.uint64) * _STEP)
        if stop < len(start):
            out[stop] = xxhash.xxh64_intdigest(part[start[stop] : end[stop]].tobytes().lower(), which)
        at = stop + 1
    return out


@dataclass
class Words:
    """The words of one window: places in `part`, whether each is new (not carried over), follows the one before it in its
    piece, and its document; hashes that hold the language, one or two."""

    part: np.ndarray
    start: np.ndarray
    end: np.ndarray
    new: np.ndarray
    follows: np.ndarray
    doc: np.ndarray
    hashes: list[np.ndarray]

    def keys(self, which: int, size: int, before: np.ndarray | None = None) -> np.ndarray:
        """Keys of the phrases of `size` words that end at each word, from those of one word less."""
        if size == 1:
            return self.hashes[which]
        out = np.zeros(len(self.start), np.uint64)
        out[1:] = _mixed(before[:-1] * _STEP + self.hashes[which][1:] + np.uint64(size))
        return out


def _end_of(data: np.ndarray, starts: np.ndarray, at: int) -> int:
    """Where the window that begins at `at` ends: after a byte that is no word's, or where a text begins."""
    if at + WINDOW >= len(data):
        return len(data)
    low, high = at, at + WINDOW
    while True:
        ends = low + np.flatnonzero(_KIND[data[low:high]]) + 1
        border = starts[np.searchsorted(starts, low, "right") : np.searchsorted(starts, high, "right")]
        # In the window's own bytes the last place, beyond it the first.
        found = [int(x[-1 if low == at else 0]) for x in (ends, border) if len(x)]
        if found:
            return max(found) if low == at else min(found)
        if high >= len(data):
            return len(data)
        low, high = high, min(len(data), high + WINDOW)


def windows(texts: pa.Array, seeds: np.ndarray, reach: int, hashes: int = 1) -> Iterator[Words]:
    """The texts' words in windows; each window begins with the `reach` words before it, which are not new."""
    texts = texts.cast(pa.large_string()).fill_null("")
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or starts[0] == starts[-1]:
        return
    data, starts = np.frombuffer(texts.buffers()[2], np.uint8)[starts[0] : starts[-1]], starts - starts[0]
    low = at = 0
    while at < len(data):
        high = _end_of(data, starts, at)
        part = data[low:high]
        kind = _KIND[part]
        word = np.zeros(len(part) + 2, bool)
        word[1:-1] = kind == 0
        border = starts[np.searchsorted(starts, low) : np.searchsorted(starts, high)] - low
        first = word[1:-1] & ~word[:-2]
        last = word[1:-1] & ~word[2:]
        first[border] = word[1:-1][border]
        inner = border[border > 0] - 1
        last[inner] = word[1:-1][inner]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        doc = np.searchsorted(starts, start + low, "right") - 1
        piece = np.searchsorted(np.flatnonzero(kind == 2), start)
        follows = np.zeros(len(start), bool)
        follows[1:] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        yield Words(part, start, end, start + low >= at, follows, doc, [_mixed(word_hashes(part, start, end, k) ^ seeds[k][doc]) for k in range(hashes)])
        low = int(start[-reach] if len(start) >= reach else start[0] if len(start) else len(part)) + low
        at = high


class Sketch:
    """Rows of counters; bits() says of each counter whether it has reached `least`."""

    def __init__(self, width: int):
        self.shift = np.uint64(64 - (width.bit_length() - 1))
        self.counters = np.zeros((DEPTH, width), np.uint8)

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        for row, factor in zip(self.counters, _ROWS, strict=True):
            at = (keys * factor) >> self.shift
            order = np.argsort(at)
            at, n = at[order], counts[order]
            heads = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
            if len(heads):
                row[at[heads]] = np.minimum(np.add.reduceat(n, heads) + row[at[heads]], 255)


class Filter:
    """What a merged sketch passes: one bit a counter, set where it reached the least number."""

    def __init__(self, bits: np.ndarray, width: int):
        self.bits, self.shift = bits, np.uint64(64 - (width.bit_length() - 1))

    def passes(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for row, factor in zip(self.bits, _ROWS, strict=True):
            at = (keys * factor) >> self.shift
            out &= (row[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
        return out


def _seeds(langs: pa.Array) -> list[np.ndarray]:
    codes = langs.dictionary_encode()
    return [np.array([xxhash.xxh64_intdigest((x or "").encode(), 7 + k) for x in codes.dictionary.to_pylist()], np.uint64)[codes.indices.to_numpy(zero_copy_only=False)] for k in range(2)]


def _phrases(words: Words, filters: list[Filter], upto: int, which: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, keys, whether a phrase that can be frequent ends at the word) for sizes to `upto`. Beyond the sizes that the filters know, only the parts are looked at."""
    keys, there = None, None
    for size in range(1, upto + 1):
        keys = words.keys(which, size, keys)
        now = np.ones(len(keys), bool)
        if size > 1:
            now[:1] = False
            now[1:] = there[:-1] & there[1:] & words.follows[1:]
        known = max(0, size - 2)
        if known < len(filters):
            at = np.flatnonzero(now)
            now[at] = filters[known].passes(keys[at])
        there = now
        yield size, keys, there


def _source(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return df.select(F.coalesce(named(lang_col).cast("string"), F.lit("und")).alias("kg_lang"), named(text_col).alias("kg_text")).where(F.length("kg_text") > 0)


def _few(df: DataFrame) -> DataFrame:
    """Twice as many tasks as the cluster runs at once: each has a sketch, or counts, of its own. But no task gets more than JOINED of
    the source's partitions, so that a cluster that has only begun to grow is not held to the few tasks it can run yet."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.rdd.getNumPartitions() // JOINED)))


def _filter(source: DataFrame, filters: list[Filter], width: int, least: int, max_words: int) -> Filter:
    """The merged sketch of the next sizes: words and pairs first, then one size a sketch."""
    spark, level = source.sparkSession, len(filters)
    shared = spark.sparkContext.broadcast(filters)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(width)
        for batch in batches:
            for words in windows(batch.column(1), _seeds(batch.column(0)), max_words - 1):
                for size, keys, there in _phrases(words, shared.value, level + 2):
                    if size == level + 2 or size < 3 and not level:
                        sketch.add(keys[there & words.new])
        blocks = sketch.counters.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        for at in range(0, len(used), 1024):
            some = used[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([blocks[k].tobytes() for k in some], pa.binary())], names=["block", "counters"])
        del sketch, blocks
        give_back()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for k, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != block:
                    if block is not None:
                        yield out()
                    block, total = k, np.zeros(BLOCK, np.int64)
                total += np.frombuffer(own.as_buffer(), np.uint8)
        if block is not None:
            yield out()

    blocks = _few(source).mapInArrow(sketched, "block int, counters binary").repartition("block").sortWithinPartitions("block").mapInArrow(merged, "block int, bits binary").toArrow()
    bits = np.zeros((DEPTH * width // BLOCK, BLOCK // 8), np.uint8)
    for k, own in zip(blocks.column("block").to_pylist(), blocks.column("bits").to_pylist(), strict=True):
        bits[k] = np.frombuffer(own, np.uint8)
    shared.unpersist()
    return Filter(bits.reshape(DEPTH, width // 8), width)


def phrase_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, max_words: int = MAX_WORDS, max_width: int = MAX_WIDTH) -> DataFrame:
    """lang, words, phrase and n (long) of all words and phrases of up to max_words words that occur `least` times; and, under
    words = 0 with an empty phrase, the number of all words of each language. A written table."""
    if not 0 < least <= 255 or max_words < 2:
        raise ValueError("least must be from 1 to 255, max_words 2 at least")
    source = _source(df, text_col, lang_col)
    size = source.agg(F.sum(F.octet_length("kg_text"))).first()[0] or 0
    width = min(max_width, max(MIN_WIDTH, 1 << max(0, size // 16 - 1).bit_length()))
    filters: list[Filter] = []
    for _ in range(max_words - 1):
        filters.append(_filter(source, filters, width, least, max_words))
    shared = df.sparkSession.sparkContext.broadcast(filters)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("phrase", T.StringType()), T.StructField("n", T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for words in windows(batch.column(1), _seeds(batch.column(0)), max_words - 1, 2):
                held.add(words, langs, shared.value, max_words)
                if len(held) > HELD:
                    yield from held.out()
        yield from held.out()

    counts = _few(source).mapInArrow(counted, schema).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    counts = staged(counts.where((F.col("words") == 0) | (F.col("n") >= least)), "phrases")
    shared.unpersist()
    return counts


class Counts:
    """Counts of phrases that can be frequent, by keys of 128 bits: equal keys are equal phrases.

    What was counted lies in arrays in the order of the keys; new phrases wait, and are sorted in when they are many."""

    def __init__(self):
        self.langs: list[str] = []
        self.totals: dict[str, int] = {}
        self.columns = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int8)]
        self.phrases = pa.array([], pa.large_binary())
        self.new: list[tuple] = []
        self.waiting = 0

    def __len__(self) -> int:
        return len(self.phrases) + self.waiting

    def add(self, words: Words, langs: list[str], filters: list[Filter], max_words: int) -> None:
        code = {x: k for k, x in enumerate(self.langs)}
        docs, n = np.unique(words.doc[words.new], return_counts=True)
        for d, k in zip(docs.tolist(), n.tolist(), strict=True):
            self.totals[langs[d]] = self.totals.get(langs[d], 0) + k
        second, raw = None, words.part.tobytes()
        for size, keys, there in _phrases(words, filters, max_words):
            second = words.keys(1, size, second)
            at = np.flatnonzero(there & words.new)
            if not len(at):
                continue
            at = at[np.argsort(keys[at], kind="stable")]
            a, b = keys[at], second[at]
            heads = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            a, b, counts, ends = a[heads], b[heads], np.diff(np.append(heads, len(at))), at[heads]
            place = np.minimum(np.searchsorted(self.columns[0], a), max(0, len(self.columns[0]) - 1))
            known = (self.columns[0][place] == a) & (self.columns[1][place] == b) if len(self.phrases) else np.zeros(len(a), bool)
            np.add.at(self.columns[2], place[known], counts[known])
            ends = ends[~known]
            found = [b" ".join(raw[i:j].lower().split()) for i, j in zip(words.start[ends - size + 1].tolist(), words.end[ends].tolist(), strict=True)]
            of = np.array([code.setdefault(langs[d], len(code)) for d in words.doc[ends].tolist()], np.int32)
            self.new.append((a[~known], b[~known], counts[~known], of, np.full(len(ends), size, np.int8), pa.array(found, pa.large_binary())))
            self.waiting += len(ends)
        self.langs = list(code)
        if self.waiting > max(MERGE, len(self.phrases) // 2):
            self.merge()

    def merge(self) -> None:
        parts = list(zip(*self.new, strict=True))
        if not parts:
            return
        a, b = (np.concatenate([self.columns[k], *parts[k]]) for k in range(2))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        heads = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        first = order[heads]
        self.columns[:2] = a[heads], b[heads]
        del a, b
        self.columns[2] = np.add.reduceat(np.concatenate([self.columns[2], *parts[2]])[order], heads)
        for k in (3, 4):
            self.columns[k] = np.concatenate([self.columns[k], *parts[k]])[first]
        self.phrases = pa.concat_arrays([self.phrases, *parts[5]]).take(pa.array(first))
        self.new, self.waiting = [], 0

    def out(self) -> Iterator[pa.RecordBatch]:
        """The counts so far, which are then forgotten."""
        self.merge()
        names, (_, _, n, of, size) = np.array([*self.langs, ""], object), self.columns
        yield pa.RecordBatch.from_arrays([pa.array(list(self.totals), pa.string()), pa.array([0] * len(self.totals), pa.int32()), pa.array([""] * len(self.totals), pa.string()), pa.array(list(self.totals.values()), pa.int64())], names=["lang", "words", "phrase", "n"])
        for at in range(0, len(n), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(names[of[part]], pa.string()), pa.array(size[part].astype(np.int32)), self.phrases[part].cast(pa.binary()).cast(pa.string()), pa.array(n[part])], names=["lang", "words", "phrase", "n"])
        self.__init__()
        give_back()


def _whole(x: Column) -> Column:
    return x.cast("decimal(15,0)")


def scored(counts: DataFrame) -> DataFrame:
    """lang, words, phrase, a, and at the lowest-scoring cut l, r and score, of the phrases of two words or more."""
    own = counts.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    words = F.split("phrase", " ")
    cuts = cuts.select("lang", "words", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("kg_first"), F.array_join(F.slice(words, F.col("k") + 1, F.col("words")), " ").alias("kg_rest"))
    part = lambda name, n: counts.where("words > 0").select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("p", "l"), (F.col("lang") == F.col("p_lang")) & (F.col("kg_first") == F.col("p"))).join(part("q", "r"), (F.col("lang") == F.col("q_lang")) & (F.col("kg_rest") == F.col("q")))
    square = (_whole(F.col("a")) * _whole(F.col("a"))).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    score = F.expr("kg_square div kg_product")
    cuts = cuts.withColumn("kg_square", square.cast("decimal(38,0)")).withColumn("kg_product", (_whole(F.col("l")) * _whole(F.col("r"))).cast("decimal(31,0)"))
    best = cuts.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("kg_best"))
    return best.select("lang", "words", "phrase", "a", "kg_best.l", "kg_best.r", "kg_best.score")


def subsumed(counts: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase) of the phrases that a longer one with at least `share` hundredths of their occurrences holds."""
    longer = counts.where("words > 2").select("lang", "words", F.col("n").alias("kg_longer"), F.split("phrase", " ").alias("kg_words"))
    longer = longer.withColumn("kg_size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("kg_at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("kg_size") + 1)))
    most = longer.groupBy(F.col("lang").alias("kg_lang"), F.array_join(F.slice("kg_words", F.col("kg_at"), F.col("kg_size")), " ").alias("kg_part")).agg(F.max("kg_longer").alias("kg_longer"))
    own = counts.where("words > 1").join(most, (F.col("lang") == F.col("kg_lang")) & (F.col("phrase") == F.col("kg_part")))
    return own.where(_whole(F.col("kg_longer")) * 100 >= _whole(F.col("n")) * share).select(F.col("lang").alias("kg_lang"), F.col("phrase").alias("kg_part"))


def mine_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, max_words: int = MAX_WORDS, share: int = SHARE, keep: int = KEEP) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score of each language's first `keep` phrases; numbers long."""
    counts = phrase_counts(df, text_col, lang_col, least, max_words)
    left = scored(counts).join(subsumed(counts, share), (F.col("lang") == F.col("kg_lang")) & (F.col("phrase") == F.col("kg_part")), "left_anti")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # The first of each of SALTS parts of a language hold its first, so no task gets all of a language's phrases.
    left = left.withColumn("kg_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    left = left.withColumn("kg_rank", F.row_number().over(Window.partitionBy("lang", "kg_salt").orderBy(*order))).where(F.col("kg_rank") <= keep)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= keep)
    totals = counts.where("words = 0").select(F.col("lang").alias("kg_of"), F.col("n").alias("kg_n"))
    return left.join(totals, F.col("lang") == F.col("kg_of")).select("lang", "rank", "phrase", "a", "l", "r", F.col("kg_n").alias("n"), "score")
