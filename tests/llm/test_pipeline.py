import pytest

import corpus_pipeline as p
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('stages')}"
    docs = [spark.read.parquet("/root/testdata/sf0.01/documents.parquet")]
    for name, stage in p.STAGES:
        stage(spark, docs[-1], "/root/testdata/sf0.01").write.parquet(f"{folder}/{name}")
        docs.append(spark.read.parquet(f"{folder}/{name}"))
    return docs


def test_each_stage_keeps_columns_and_takes_effect(stages):
    counts = [d.count() for d in stages]
    assert [d.columns for d in stages[:5]] == [stages[0].columns] * 5
    assert counts[0] >= counts[1] >= counts[2] > counts[3] > counts[4] > 0 and counts[1] > 0.97 * counts[0]


def test_clean_documents_stay(stages, spark):
    from keelgrid.llm.queries import op8_decontamination

    bad = {r.doc_id for r in op8_decontamination(spark, "/root/testdata/sf0.01").where("n_hit > 0").select("doc_id").collect()}
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (stages[3], stages[4]))
    assert set(before) - set(after) <= bad
    assert all(after[i] == before[i] for i in after)


def test_one_of_each_class_stays(stages):
    """Classes of 5-word shingles with a Jaccard index of 0.8, every pair that shares a shingle compared."""
    sets, having = {}, {}
    for r in stages[2].select("doc_id", "text").collect():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "").encode().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else {()})
        for x in sets[r.doc_id]:
            having.setdefault(x, set()).add(r.doc_id)
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, x in sets.items():
        for j in {j for s in x for j in having[s] if j < i}:
            if len(x & sets[j]) / len(x | sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                least[b] = a
    assert {i for i in least if find(i) == i} == {r.doc_id for r in stages[3].select("doc_id").collect()}


def test_sequences_hold_every_document_that_is_left(stages):
    by = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert by.where("n <> m").count() == 0 and by.count() == stages[4].count()


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "the quick brown fox and the lazy dog went over the hill to the sea"
    rows = [(i, f"{text} {i}\n{text} {i * 7}", "en", "s", 10) for i in range(30)] + [(None, text, None, None, None), (31, None, "en", None, None), (32, "", None, None, 0), (1, rows_text := f"{text} 1\n{text} 7", "en", "s", 10), (33, rows_text, "en", "s", 10)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in p.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
        docs.collect()


NAMES = ["score", "lang_pred", "held_out", "kg_key", "kg_hash", "kg_id", "kg_none", "line_count", "removed_lines", "kg_lines", "kg_score", "line.count", "a`b", "own_text", "segment", "fp"]


def test_further_columns_pass_through_whatever_their_names(spark):
    text = "the quick brown fox and the lazy dog went over the hill to the sea"
    rows = [(i, f"{text} {i}\n{text} {i * 7}", "en", "s", 10, *(f"{n} {i}" for n in NAMES)) for i in range(30)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *NAMES])
    want = {r.doc_id: tuple(r)[5:] for r in docs.collect()}
    for _, stage in p.STAGES[:-1]:
        after = stage(spark, docs, "/root/testdata/sf0.001")
        assert after.columns == docs.columns
        rows = after.collect()
        assert rows and all(tuple(r)[5:] == want[r.doc_id] for r in rows)


def test_planted_near_copies_are_caught(spark):
    import random

    rng = random.Random(12)
    words = [f"word{i}" for i in range(900)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([40, 120, 600]))]
        for c in range(3):  # each change of a word spoils five shingles of the text at most
            other = list(base)
            for _ in range(c * len(base) // 100):
                other[rng.randrange(len(base))] = "changed"
            rows.append((3 * k + c, " ".join(other)))
    kept = {r.doc_id for r in p.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    caught = sum(i not in kept for i in range(180) if i % 3)
    assert {i for i in range(0, 180, 3)} <= kept and caught >= 0.9 * 120
