import corpus_pipeline
from keelgrid.llm.linededup import dedup_lines

ROWS = [(1, "one line"), (2, "one line"), (3, "two\nlines"), (4, "two\nlines"), (5, "lines\ntwo"), (6, "one line\n"), (7, ""), (8, ""), (9, " "), (10, " "), (11, None), (12, "a\nb\nc"), (13, "a\nb\nc\nd"), (14, "two\nlines\nmore"), (2, "one line")]


def test_short_texts_are_one_window(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    found = sorted((r.doc_id, r.text, r.line_count, r.removed_lines) for r in dedup_lines(df, short=True).collect() if r.doc_id != 11)
    gone = {2: ("", 1, 1), 4: ("", 2, 2), 13: ("d", 4, 3)}
    assert found == sorted((i, *gone.get(i, (t, t.count("\n") + 1, 0))) for i, t in ROWS if i != 11)
    assert {r.doc_id: r.removed_lines for r in dedup_lines(df).collect() if r.removed_lines} == {13: 3}
    assert "Python" not in dedup_lines(df, short=True)._jdf.queryExecution().toString()


def test_stage_drops_repeated_short_texts(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.line_dedup(spark, df, "").collect())
    assert kept == [1, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]
