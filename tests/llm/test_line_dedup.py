import random

from keelgrid.llm.linededup import dedup_lines


def plain(rows, size=3):
    """rows: distinct (id, text)."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out[i] = (None, 0, 0)
            continue
        lines = text.split("\n")
        covered = set()
        for p in range(len(lines) - size + 1):
            w = tuple(lines[p : p + size])
            if not any(x.strip(" ") for x in w):
                continue
            if w in seen:
                covered.update(range(p, p + size))
            seen.add(w)
        out[i] = ("\n".join(x for p, x in enumerate(lines) if p not in covered), len(lines), len(covered))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, kg_id int, line_count string")
    return dedup_lines(df).collect()


def test_against_a_plain_version(spark):
    random.seed(5)
    rows = [(i, "\n".join(random.choice("abc ") for _ in range(random.randint(0, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x"), (None, "p\nq\nr\ns"), (103, "p\nq\nr\ns\nt"), (104, "\n\n\n\n"), (105, "\n\n\n\n")]
    found = {r.doc_id: (r.text, r.line_count, r.removed_lines) for r in run(spark, rows)}
    assert found == plain(rows)


def test_repeated_rows_and_empty_table(spark):
    found = run(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "z\na\nb\nc")])
    assert sorted((r.doc_id, r.text, r.removed_lines) for r in found) == [(1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, "z", 3)]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_text_and_native_plan(spark):
    text = "\n".join(f"line {i % 5000}" for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = dedup_lines(df)
    assert out.first().text.count("\n") < 5003
    assert "Python" not in out._jdf.queryExecution().toString()
