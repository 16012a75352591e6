import math
import random
import zlib
from collections import Counter

import numpy as np
from keelgrid.llm.features import gram_counts
from keelgrid.llm.langid import Ftrl, document_frequencies, fit, identify, predict, softmax


def test_slices_count_like_whole_texts():
    texts = ["abc def " * 40, "", "é", "xyz" * 500]
    whole = gram_counts(texts, 512)
    assert np.array_equal(whole, gram_counts(texts, 512, slice_=50))
    assert np.array_equal(whole[3], gram_counts([texts[3]], 512, slice_=7)[0])
    assert whole[0].sum() == sum(len(texts[0]) + 2 - n + 1 for n in (1, 2, 3))


def test_ftrl_learns_and_stays_sparse():
    rng, f = np.random.default_rng(1), Ftrl(50, 3)
    for _ in range(600):
        y = int(rng.integers(3))
        f.learn(np.array(sorted({y, 10 + int(rng.integers(40))})), np.array([0.8, 0.6]), y)
    w = f.weights()
    assert all(w[y, y] > 0.5 and w[y].argmax() == y for y in range(3)) and (w[3:10] == 0).all()
    assert np.allclose(softmax(np.array([[1e4, 0.0]])), [[1, 0]])


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = identify(docs).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    right = np.mean([r.lang_pred == lang[r.doc_id] for r in held])
    assert right > 0.97 and abs(np.mean([r.score for r in held]) - right) < 0.05


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog " * 5, "en") for i in range(20)] + [(i, "le chat et le chien " * 5, "fr") for i in range(20, 40)]
    rows += [(50, None, "en"), (51, "", "fr"), (52, "123 !?", "en"), (None, "the dog", None), (53, "le chien", None), (53, "le chien", None), (54, "the " * 30000, "en"), (55, "中", None)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    got = identify(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [by[i].lang_pred for i in (50, 51, 52)] == ["und"] * 3
    assert by[54].lang_pred == "en" and by[53].lang_pred == "fr" and by[None].lang_pred == "en" and by[55].lang_pred in ("en", "fr")
    assert {r.lang_pred for r in identify(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert identify(df.limit(0)).collect() == []


def plain_grams(text, buckets):
    """Counts of the hashed 1- to 3-grams, one by one."""
    codes = [c if c >= 128 or 97 <= c <= 122 else 32 for c in map(ord, f" {(text or '').lower()} ")]
    m, out = (1 << 32) - 1, Counter()
    for i in range(len(codes)):
        h = 0
        for n in (1, 2, 3):
            if i + n > len(codes):
                break
            h = (h * 0x01000193 & m) ^ (codes[i + n - 1] * 0x9E3779B1 + n & m)
            x = (h ^ h >> 15) * 0x85EBCA6B & m
            out[(x ^ x >> 13) & buckets - 1] += 1
    return out


def test_predictions_against_a_plain_version(spark):
    rng = random.Random(2)
    words = {"en": "the dog and cat of hill".split(), "fr": "le chien et la \u00e9t\u00e9 colline".split(), "de": "der Hund und die K\u00e4tze".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randrange(1, 40))), k) for i in range(90) for k in [rng.choice(list(words))]]
    rows += [(90, "12 !?", "en"), (91, None, None), (92, "", None), (93, "cat " * 20_000, "en"), (94, "\u4e2d x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = fit(df, "text", "lang", "doc_id", buckets=256)
    learned = [t for _, t, k in rows if k and t is not None]
    frequency, count = document_frequencies(df.where("lang is not null and text is not null"), "text", 256)
    grams = [plain_grams(t, 256) for t in learned]
    assert count == len(learned) and frequency.tolist() == [sum(b in g for g in grams) for b in range(256)]
    idf = [math.log((1 + count) / (1 + f)) for f in frequency.tolist()]
    for r in predict(df, m).collect():
        text = rows[r.doc_id][1]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        x = {b: n * idf[b] for b, n in plain_grams(text, 256).items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1
        z = [(sum(v / norm * float(m.weights[b, k]) for b, v in x.items()) + float(m.bias[k])) / m.temperature for k in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        assert r.lang_pred == m.labels[int(np.argmax(e))] and abs(r.score - max(e) / sum(e)) < 1e-3
