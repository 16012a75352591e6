import random

import corpus_pipeline
import pytest
from keelgrid.llm import simhash
from pyspark.sql import functions as F


def shingles(text, size=5):
    w = (text or "").split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def smallest(rows, least=0.8):
    """rows: (id, text); the smallest id of each class, every pair compared."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (len(a & b) / len(a | b) if a | b else 1.0) >= least:
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return sorted(i for i in up if find(i) == i)


def rows():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " ", "one two", "one  two", "one two three", "three one two"]
    for n in (6, 30, 150, 3000):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(n)]
            texts.append(" ".join(base))
            for changes in (1, 2, 3, 4, n // 60, n // 40, n // 20):
                other = list(base)
                for _ in range(changes):
                    other[rng.randrange(n)] = "new"
                texts += [" ".join(other), " ".join(base[: n - changes])]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_against_every_pair(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in rows()], "doc_id long, text string, fp string")
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == smallest(rows())


def test_chain_in_one_bucket(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [(k, " ".join([*base[3 * k :], *(f"v{i}" for i in range(3 * k))])) for k in range(12)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert smallest(texts) == [0] == [r.doc_id for r in simhash.keep_one(df, least=0.8).collect()]


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "q r"), (None, "q r")], "doc_id long, text string")
    assert sorted((r.doc_id or -1) for r in simhash.keep_one(df, least=0.8).collect()) == [-1, 5]
    assert simhash.keep_one(df.limit(0), least=0.8).collect() == []


def templates(copies, seed=3):
    """Copies of two templates, each with a word of its own; texts of likeness 0.7 to 0.85 to the first; some far apart."""
    rng = random.Random(seed)
    first, second = ([f"{k}{i}" for i in range(120)] for k in "ab")
    texts = []
    for k in range(copies):
        base = list(first if k % 3 else second)
        base[rng.randrange(120)] = f"own{k}"
        texts.append(base)
    for k in range(20):
        base = list(first)
        for _ in range(rng.randrange(2, 5)):
            base[rng.randrange(120)] = f"out{k}"
        texts.append(base)
    texts += [[f"z{k}{i}" for i in range(50)] for k in range(5)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_copies_of_templates_against_every_pair(spark):
    texts = templates(260)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df, least=0.8).collect()) == smallest(texts)


@pytest.mark.parametrize("second", [20, 400])
def test_pairs_grow_in_proportion_with_a_class(spark, second):
    """One class of 1,000, 2,000, 4,000 shapes, others of `second` and of one: never the square of the first."""
    for copies in (1000, 2000, 4000):
        of = F.when(F.col("id") < copies, 1).when(F.col("id") < copies + second, 2).otherwise(F.col("id"))
        shapes = spark.range(copies + second + 10).select(F.lit(0).alias("band"), F.lit(7).alias("value"), of.cast("long").alias("root"), F.lit(9).alias("size"), F.lit(9).alias("common"), F.col("id").alias("fp"), F.array(F.lit(1)).alias("parts"))
        found = simhash.between_classes(shapes)
        assert found.count() == copies * second + (copies + second) * 10 + 45
        assert shapes.where("root <> 1").count() * shapes.count() <= 2 * found.count() + (second + 10) ** 2  # the bucket's join

