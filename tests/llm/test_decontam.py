import hashlib
import random
import re

from keelgrid.llm.decontam import build_index, contamination, search


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, size=13):
    out = []
    for i, text in docs:
        w = words(text)
        hit, names = set(), set()
        for name, item in items:
            v = words(item)
            for k in range(max(1, len(v) - size + 1)) if v else ():
                x = v[k : k + size]
                for p in range(len(w) - len(x) + 1):
                    if w[p : p + len(x)] == x:
                        hit.update(range(p, p + len(x)))
                        names.add("null" if name is None else str(name))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def data():
    rng = random.Random(6)
    vocabulary = [*"abcdefg", "É", "x1", "中文"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((1, 2, 3, 5, 13, 14, 20, 40))] + [(50, None), (51, ""), (52, " ?! "), (None, text(4)), (2, text(3)), (53, "A,b;C")]
    docs = [(i, text(n)) for i, n in enumerate((0, 1, 2, 13, 30, 100, 400))]
    docs += [(20, None), (21, "  "), (22, items[7][1] + " tail"), (23, "head " + items[5][1].upper()), (24, items[4][1]), (None, items[7][1]), (24, items[4][1]), (25, "q " * 5000 + items[6][1]), (26, items[4][1].rsplit(" ", 1)[0]), (27, items[4][1].rsplit(" ", 1)[1])]
    return docs, items


def frames(spark):
    docs, items = data()
    return spark.createDataFrame([(i, t, "n", [1]) for i, t in docs], "doc_id long, text string, n_words string, docs array<int>").repartition(2), spark.createDataFrame(items, "item_id long, text string")


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def test_against_a_plain_version_in_one_block_and_in_many(spark):
    docs, items = frames(spark)
    for block in (200_000, 15):
        assert result(contamination(docs, items, block_words=block)) == plain(*data())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha one beta two gamma"), (2, "alpha beta gamma"), (3, "gamma far far far far far beta far far far alpha"), (4, "alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    got = {r.doc: (r["items"], r.near) for r in search(build_index(docs), items, slop=2).collect()}
    assert got == {1: ([], ["9"]), 2: (["9"], ["9"]), 3: ([], []), 4: ([], [])}


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert contamination(docs.limit(0), items).collect() == []
    assert {r.n_hit for r in contamination(docs, items.limit(0)).collect()} == {0}


def near(docs, item, slop):
    """By trying every place."""
    v, out = words(item), set()
    for i, text in docs:
        w = words(text)
        at = {x: [k for k, y in enumerate(w) if y == x] for x in v}
        if any(all(any(abs(q - j - p) <= slop for q in at[x]) for j, x in enumerate(v)) for p in range(-slop - len(v), len(w) + slop)):
            out.add(i)
    return out


def test_proximity_is_the_same_however_documents_are_cut(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdexyz") for _ in range(rng.randrange(1, 12)))) for i in range(60)] + [(60, "a x b y c"), (61, "alpha beta x"), (62, "gamma delta"), (63, "")]
    items = [(0, "a b c"), (1, "alpha beta gamma"), (2, "d e"), (3, "x y z a")]
    for parts in (1, 7, 40):
        index = build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts, "doc_id"))
        for slop in (1, 2):
            got = {r.doc: set(r.near) for r in search(index, spark.createDataFrame(items, "item_id long, text string"), slop=slop).collect()}
            for i, item in items:
                assert {d for d, n in got.items() if str(i) in n} == near(docs, item, slop), (parts, slop, item)
