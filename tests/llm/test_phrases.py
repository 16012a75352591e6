"""Collocations against counting with dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from keelgrid.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, max_words=3, share=50, keep=2000):
    f, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(ws)
            for s in range(1, max_words + 1):
                f.update((lang, *ws[i : i + s]) for i in range(len(ws) - s + 1))
    able = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    gone = set()
    for (lang, *ws), a in able.items():
        for s in range(2, len(ws)):
            for i in range(len(ws) - s + 1):
                part = (lang, *ws[i : i + s])
                if 100 * a >= share * f[part]:
                    gone.add(part)
    out = []
    for lang in totals:
        found = []
        for k, a in able.items():
            if k[0] == lang and k not in gone:
                score, _, l, r = min((1_000_000 * a * a // (f[k[: c + 1]] * f[(lang, *k[c + 1 :])]), c, f[k[: c + 1]], f[(lang, *k[c + 1 :])]) for c in range(1, len(k) - 1))
                found.append((-score, -a, " ".join(k[1:]).encode(), l, r))
        out += [(lang, n, p.decode(), -a, l, r, totals[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(found)[:keep], 1)]
    return sorted(out)


def corpus(seed, docs=300):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "Éa", "x\x00y", "über", "😀", "a b", "c\td", "日本", "w" * 1500, "W" * 1500] + [f"r{i}" for i in range(400)]
    weight = [40, 30, 20, 20, 15, 5, 5, 5, 5, 5, 5, 5, 2, 2] + [1] * 400
    rows = []
    for i in range(docs):
        ws = rng.choices(words, weights=weight, k=rng.randrange(60))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x0c", "\r\n", " ! "]) for w in ws)
        rows.append((text, rng.choice(["en", "en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", "xx"), (" . ", "yy"), ("new york city " * 30, "zz"), ("new york city " * 30, "zz")]


def mined(spark, rows, **more):
    df = spark.createDataFrame([(t, lang, 0, "n") for t, lang in rows], "text string, lang string, n int, `kg.phrase` string").repartition(3)
    out = phrases.mine_phrases(df, **more)
    assert dict(out.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(["rank", "a", "l", "r", "n", "score"], "bigint")
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("more", [{}, {"max_words": 4, "least": 4, "keep": 7}, {"max_words": 2, "least": 3, "share": 20}])
def test_phrases_are_those_of_plain_counting(spark, more):
    rows = corpus(3, 1200)
    want = plain(rows, **more)
    assert len(want) > 6 and mined(spark, rows, **more) == want


def test_empty_and_wordless_tables(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None), ("", "en"), (" .\n", "en")]) == []


def test_windows_give_each_word_and_phrase_once(monkeypatch):
    """Windows far smaller than the texts, and words longer than a window."""
    rows = corpus(9, 60) + [("z" * 300 + " tail end of it", "en"), ("q" * 777, "en")]
    texts, want = pa.array([t for t, _ in rows]), Counter()
    for text, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            want.update(" ".join(ws[i : i + s]) for s in (1, 2, 3) for i in range(len(ws) - s + 1))
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(phrases, "WINDOW", size)
        monkeypatch.setattr(phrases, "MERGE", 5 * size)
        held = phrases.Counts()
        everything = [phrases.Filter(np.full((phrases.DEPTH, 8192), 255, np.uint8), 1 << 16)] * 2
        seeds = [np.zeros(len(rows), np.uint64)] * 2
        for words in phrases.windows(texts, seeds, 2, 2):
            held.add(words, [""] * len(rows), everything, 3)
        got = Counter({p: c for batch in held.out() for s, p, c in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True) if s})
        assert len(held) == 0
        assert got == want


def test_a_sketch_never_says_too_little():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sketch, seen = phrases.Sketch(1 << 12), Counter()
    for _ in range(20):
        some = rng.choice(keys, 2000)
        sketch.add(some)
        seen.update(some.tolist())
    passed = phrases.Filter(np.packbits(sketch.counters >= 15, axis=1), 1 << 12).passes(keys)
    assert all(passed[i] for i, k in enumerate(keys.tolist()) if seen[k] >= 15)
    assert not passed.all()


def test_a_sketch_far_too_small_changes_nothing(spark, monkeypatch):
    rows = corpus(4, 200)
    df = spark.createDataFrame(rows, "text string, lang string")
    small, large = (sorted(map(tuple, phrases.phrase_counts(df, max_width=w).collect())) for w in (phrases.BLOCK, 1 << 20))
    assert small == large
