import hashlib
import random
import struct
from collections import Counter

import xxhash
from keelgrid.llm.shared import with_blocks
from keelgrid.llm.winnow import compare_edited, fingerprints
from pyspark.sql import functions as F


def h(value, seed=42):
    data = value.encode() if isinstance(value, str) else struct.pack("<q", value)
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(data, seed % (1 << 64))))[0]


MASK = (1 << 64) - 1


def rolled(codes, k):
    """The k codes shifted and combined, each k-gram by itself."""
    out = []
    for i in range(max(1, len(codes) - k + 1)) if codes else ():
        x = 0
        for c in codes[i : i + k]:
            x = (x << 1 ^ c % (1 << 64)) & MASK
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def smallest(g, w):
    """Of each window the place of the smallest, told by bits 30 to 62, rightmost on ties."""
    out = []
    for i in range(max(1, len(g) - w + 1)) if g else ():
        j = -min((g[j] >> 30 & (1 << 33) - 1, -j) for j in range(i, min(len(g), i + w)))[1]
        if j not in out[-1:]:
            out.append(j)
    return [g[j] for j in out], out


def selected(text, k=4, w=8):
    return smallest(rolled([h(x) for x in (text or "").lower().split()], k), w)


def texts():
    random.seed(2)
    words = [str(x) for x in range(30)]
    return [" ".join(random.choice(words) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 8, 11, 12, 40, 200)] + [None, "  \n ", "z" * 100, "a " * 300, "É é ñ ü " * 20]


def test_fingerprints_against_a_plain_version(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    for r in fingerprints(df).collect():
        assert (r.fingerprint.hashes, r.fingerprint.positions) == selected(texts()[r.doc_id]), r.doc_id


def test_every_long_shared_run_is_found(spark):
    random.seed(8)
    for _ in range(20):
        run = " ".join(str(random.random()) for _ in range(11))
        a, b = (" ".join([*(str(random.random()) for _ in range(random.randint(0, 30))), run, *(str(random.random()) for _ in range(9))]) for _ in range(2))
        assert set(selected(a)[0]) & set(selected(b)[0])


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    """rows: (id, text), in the order of ids."""
    out = []
    for n, (i, text) in enumerate(rows):
        text, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own = selected(text)[0]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(own, selected(edited)[0]), 9), round(jaccard(own, selected(after)[0]), 9)))
    return out


def compared(df, width=256):
    return [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in compare_edited(df, width=width).orderBy(F.asc_nulls_first("doc_id")).collect()]


def test_edited_texts_over_blocks_and_gaps(spark):
    ids = [-700, -1, 0, 1, 2, 3, 9, 100, 101, 5000, 5001, 1 << 40, (1 << 40) + 1, 1 << 61, (1 << 61) + 5, (1 << 62)]
    rows = list(zip(ids, texts(), strict=True))
    df = spark.createDataFrame([(i, t, "c") for i, t in random.sample(rows, len(rows))], "doc_id long, text string, kg_block string")
    for width in (2, 256):
        assert compared(df, width) == plain(rows)


def test_null_id_single_row_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (4, "g h i j k l m")]
    assert compared(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)
    assert compared(spark.createDataFrame([(4, "abcd")], "doc_id long, text string"))[0][2] == hashlib.sha256(b"abab").hexdigest()
    assert compared(spark.createDataFrame([], "doc_id long, text string")) == []
    assert len(compared(spark.createDataFrame([(4, "x y"), (4, "x y"), (4, "z")], "doc_id long, text string"))) == 3


def test_blocks_of_ids_of_any_kind(spark):
    random.seed(4)
    cluster = [1 << 61 | i for i in range(3000)]
    for ids in ([random.getrandbits(63) for _ in range(5000)], list(range(5000)), cluster + [5, -(1 << 62)], [None] * 3000 + [5, 6], [7] * 10, []):
        df = spark.createDataFrame([(i, str(k)) for k, i in enumerate(ids)], "doc_id long, text string")
        rows = with_blocks(df, "doc_id", F.shiftright(F.xxhash64("text"), 52) + 2048, "b", 64).select("doc_id", F.xxhash64("text").alias("h"), "b").collect()
        if len(set(ids)) > 7 or None in ids:
            assert max(Counter(r.b for r in rows).values()) <= 256
        low = -(1 << 63)
        ordered = sorted(rows, key=lambda r: (low, r.h) if r.doc_id is None else (r.doc_id, 0))
        assert all(a.b <= b.b for a, b in zip(ordered, ordered[1:], strict=False))
