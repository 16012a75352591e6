"""Samples with null, repeated and rare rows, and what is learned from them."""

import random

import corpus_pipeline
import pytest
from keelgrid.llm import langid, quality
from keelgrid.llm.sampling import chosen, key_of, shares
from pyspark.sql import functions as F

WORDS = {"en": "the and of house water letter", "fr": "le et des maison eau lettre", "de": "der und von haus wasser brief", "es": "el y del casa agua carta"}


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(" ".join(rng.choices(WORDS[k].split(), k=12)) + f" {i}", k) for i in range(n) for k in [list(WORDS)[i % 4]]]


def drawn(df, rows):
    key = key_of(F.col("id").cast("string"), F.col("text"))
    by = shares(df, "lang", key, F.length("text"), rows, 10**9)
    return df.where(chosen(key, "lang", by)).withColumn("k", key)


@pytest.mark.parametrize("id_", ["id", "CAST(NULL AS LONG)", "CAST(7 AS LONG)"])
def test_rows_without_ids_or_of_one_id_are_drawn_like_others(spark, id_):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(texts(8000))], "id long, text string, lang string").selectExpr(f"{id_} AS id", "text", "lang")
    counts = dict(drawn(df, 800).groupBy("lang").count().collect())
    assert all(130 < counts[k] < 270 for k in WORDS)


def test_shares_below_a_millionth_draw_few(spark):
    df = spark.range(20_000_000).selectExpr("id", "CAST(id AS STRING) AS text", "'x' AS lang")
    key = key_of(F.col("id").cast("string"), F.col("text"))
    assert df.where(chosen(key, "lang", {"x": 1e-6})).count() < 60


def test_repeated_rows_do_not_fill_the_sample(spark):
    rows = spark.createDataFrame([(None, "one text", "en")], "id long, text string, lang string").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("k")
    rest = spark.createDataFrame([(i, *x) for i, x in enumerate(texts(400))], "id long, text string, lang string")
    both = rows.unionByName(rest)
    assert drawn(both, 200).select("k").distinct().count() < 280
    model = langid.fit(both, "text", "lang", "id", rows=200, buckets=512)
    assert model.labels == sorted(WORDS) and abs(model.weights).sum() > 0


def test_a_sample_of_one_row_is_no_empty_sample(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(texts(2000))], "id long, text string, lang string")
    model = langid.fit(df, "text", "lang", "id", rows=1, buckets=512)
    assert model.labels == sorted(WORDS) and abs(model.weights).sum() > 0


def test_the_language_stage_keeps_clean_texts_whatever_their_ids(spark):
    rows = [(i, t, k, "s", len(t)) for i, (t, k) in enumerate(texts(6000))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for id_ in ("doc_id", "CAST(NULL AS LONG)"):
        kept = corpus_pipeline.language_id(spark, df.withColumn("doc_id", F.expr(id_)), "")
        assert kept.count() == 6000


def test_quality_learns_from_a_hot_id_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i % 50, f"good text number {i}" if i % 2 else f"BAD!!! {i} $$$") for i in range(3000)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] * 3, "doc_id long, quality int, toxic int")
    machine = quality.learn(docs, labels, "doc_id", "text", "quality", rows=100, buckets=256)
    assert machine.score(["good text number 5"], quality.np.zeros((1, 0)))[0] > machine.score(["BAD!!! 7 $$$"], quality.np.zeros((1, 0)))[0] + 0.3
