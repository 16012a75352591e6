import random

import pytest
import xxhash
from keelgrid.llm.queries import op4_winnowing
from keelgrid.llm.winnow import compare_edited, winnow
from pyspark.sql import functions as F


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def digest(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed % (1 << 64))


def selected(text, k=4, w=4):
    codes = [digest(y.encode()) for x in text or "" for y in [x.lower()]]
    g = []
    for i in range(max(1, len(codes) - k + 1)) if codes else ():
        s = 0
        for c in codes[i : i + k]:
            s = (s << 1 ^ c) & (1 << 64) - 1
        g.append(signed(s))
    out = []
    for i in range(max(1, len(g) - w + 1)) if g else ():
        j = -min((g[j] >> 30 & (1 << 33) - 1, -j) for j in range(i, min(len(g), i + w)))[1]
        if j not in out:
            out.append(j)
    return [g[j] for j in out], out


def test_characters_against_a_plain_version(spark):
    random.seed(3)
    texts = ["".join(random.choice("abC é\n\U0001f600\u4e2d") for _ in range(n)) for n in (*range(12), 40, 300)] + [None, "  ", "aaaaaaaaaaaa", "\u0391\u03a3 \u0130STANBUL \u03a3", "\u00c9T\u00c9 STRASSE" * 9, "word " * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in df.select("doc_id", winnow(F.col("text"), 4, 4, chars=True).alias("f")).collect():
        assert (r.f.hashes, r.f.positions) == selected(texts[r.doc_id]), texts[r.doc_id]


@pytest.fixture
def found(spark, tmp_path):
    def run(rows):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        return {r.doc_id: r for r in op4_winnowing(spark, str(tmp_path)).collect()}

    return run


def test_short_texts_stay_near_their_edited_text(found):
    words = "harbour window copper melody quarter blanket silver journey marble thunder".split()
    rows = [(i, " ".join(words[(i * 3 + j) % 10] for j in range(2 + i % 5))) for i in range(20)]
    assert all(r.near_edited > r.near_next for r in found(rows).values())


def test_unspaced_text_at_another_offset(spark):
    random.seed(5)
    run = "".join(chr(0x4E00 + random.randrange(3000)) for _ in range(400))
    df = spark.createDataFrame([(run, "中文字符串" + run)], "a string, b string")
    hashes = lambda c: winnow(F.col(c), 4, 4, chars=True)["hashes"]
    r = df.select(hashes("a").alias("a"), hashes("b").alias("b"), winnow(F.col("a"))["hashes"].alias("c"), winnow(F.col("b"))["hashes"].alias("d")).first()
    assert len(set(r.a) & set(r.b)) > 0.95 * len(set(r.a)) and not set(r.c) & set(r.d)


def test_edited_fingerprints_put_together_from_parts(spark):
    random.seed(1)
    rows = [(i, "".join(random.choice("ab cA\u00e9\U0001f600") for _ in range(random.choice([0, 3, 20, 30, 40, 60, 100, 301, 30_000 if i == 9 else 50])))) for i in range(200)]
    found = {r.doc_id: r for r in compare_edited(spark.createDataFrame(rows, "doc_id long, text string"), k=4, window=4, chars=True, width=16).collect()}
    for n, (i, text) in enumerate(rows):
        after, half = rows[(n + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (found[i].edited_fingerprint.hashes, found[i].edited_fingerprint.positions) == selected(edited), (i, edited)
        a, b, c = (set(selected(x)[0]) for x in (text, edited, after))
        for x, y in ((b, found[i].near_edited), (c, found[i].near_next)):
            assert abs((len(a & x) / len(a | x) if a | x else 1) - y) < 1e-9
