import math
import random
import zlib

import numpy as np
from keelgrid.llm.quality import FactorisationMachine, judge, learn, score


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    x, v, w = rng.random((5, 7)).astype(np.float32), rng.random((7, 3)).astype(np.float32), rng.random(7).astype(np.float32)
    m = FactorisationMachine(0.3, w, v, np.zeros(1), np.ones(1), 6)
    pairs = [0.3 + r @ w + sum(v[i] @ v[j] * r[i] * r[j] for i in range(7) for j in range(i)) for r in x]
    assert np.allclose(m.margin(x), pairs, atol=1e-4)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = {r.doc_id: r for r in judge(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in found.items())
    held = [(found[r.doc_id].score, r.quality) for r in labels.collect() if found[r.doc_id].held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "x y", 7), (3, "word " * 9000, 8), (3, "word " * 9000, 8)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in judge(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(1, 0), (2, None), (3, 1), (None, 1), (9, 1), (3, 5)], "doc_id long, quality int")
    rows = judge(docs, some).collect()
    assert len(rows) == 5 and rows[0].score == rows[1].score
    assert judge(docs.limit(0), some).collect() == []


M = (1 << 64) - 1


def word_hash(w):
    h, power = 0, 1
    for k, b in enumerate(w):
        power = 0x100000001B3 if k % 64 == 0 else power * 0x100000001B3 & M
        h = h + (b + 1) * power & M
    h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & M
    return h ^ h >> 32


def plain_inputs(text, n_chars, buckets):
    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words = low.split()
    hashes = [word_hash(w) for w in words]
    x = [0.0] * buckets
    for h in hashes:
        x[h % buckets] += 1
    kinds, total = sum(v > 0 for v in x), max(sum(x), 1)
    x = [math.sqrt(v / total) for v in x]
    some, size, padded = max(len(words), 1), max(len(raw), 1), raw + b"\n"
    is_ = {"upper": lambda b: 65 <= b <= 90, "digit": lambda b: 48 <= b <= 57, "high": lambda b: b >= 128}
    sign = lambda b: b not in b"\t\n\v\f\r " and not any(f(b) for f in is_.values()) and not 97 <= b <= 122
    share = lambda f: sum(map(f, padded)) / size
    white = sum(b in b"\t\n\v\f\r " for b in padded)
    x += [math.log1p(len(raw)), math.log1p(len(words)), math.log1p((size - white + 1) / some), share(is_["upper"]), share(is_["digit"]), share(sign), share(is_["high"])]
    x += [padded.count(b"\n") / some, sum(a == b for a, b in zip(hashes, hashes[1:], strict=False)) / some, kinds / min(some, buckets)]
    x += [sum(a == b and sign(b) for a, b in zip(padded, padded[1:], strict=False)) / size]
    starts = [k for k in range(len(raw)) if padded[k] not in b"\t\n\v\f\r " and (k == 0 or padded[k - 1] in b"\t\n\v\f\r ")]
    x += [sum(b - a <= 4 for a, b in zip(starts, [*starts[1:], len(padded)], strict=False)) / some]
    return np.array([*x, math.copysign(math.log1p(abs(n_chars or 0)), n_chars or 0)])


def test_scores_against_a_plain_version(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "Fox", "a", "x9", "!!", "$$$", "\u00e9t\u00e9", "12", "buy", "WORD" * 30])
    rows = [(i, rng.choice(["", "   "]) + " ".join(word() for _ in range(rng.choice([1, 3, 8, 30]))) + rng.choice(["", "\n", " ...\n\nend"]), rng.choice([None, 0, -5, 40, 9000])) for i in range(60)]
    rows += [(60, None, 3), (61, "", None), (62, "word " * 30_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    m = learn(df, labels, "doc_id", "text", "quality", ("n_chars",), buckets=32)
    got = {r.doc_id: r.score for r in score(df, m, metadata=("n_chars",)).collect()}
    for i, text, n_chars in rows:
        x = plain_inputs(text, n_chars, 32)
        x[32:] = np.clip((x[32:] - m.mean) / m.scale, -4, 4)
        pairs = sum(float(m.factors[a] @ m.factors[b]) * x[a] * x[b] for a in range(len(x)) for b in range(a))
        want = 1 / (1 + math.exp(-(m.bias + float(x @ m.linear) + pairs)))
        assert abs(got[i] - want) < 1e-3, (i, got[i], want)
