import random

import numpy as np
import xxhash
from keelgrid.llm import simhash
from keelgrid.llm.components import connected_components


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    sums = [0] * 64
    for s in shingles:
        x = xxhash.xxh64_intdigest(s, 42)
        for j in range(64):
            sums[j] += x >> j & 1
    return sum(1 << j for j in range(64) if 2 * sums[j] > len(shingles))


def classes(values, radius=2):
    """values: name to fingerprint; name to the smallest name it reaches."""
    names = sorted(values)
    up = {n: n for n in names}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {n: find(n) for n in names}


def around(rng, n, flips):
    centre = rng.getrandbits(64)
    out = []
    for _ in range(n):
        x = centre
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


def test_bk_tree_finds_every_link():
    rng = random.Random(1)
    members = np.array(sorted({*around(rng, 60, 3), *around(rng, 60, 6), *(rng.getrandbits(64) for _ in range(100))}), np.uint64)
    links = simhash.bk_links(members)
    joined = {i: i for i in range(len(members))}
    for a, b in links:
        assert (int(members[a]) ^ int(members[b])).bit_count() <= 2
    want = classes({i: int(m) for i, m in enumerate(members)})
    for _ in range(len(members)):
        for a, b in links:
            joined[a] = joined[b] = min(joined[a], joined[b])
    assert joined == want and len(links) == len(members) - len(set(want.values()))


def test_long_vote():
    h = np.random.default_rng(0).integers(0, 1 << 63, 70_000, dtype=np.uint64) * np.uint64(2)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    assert simhash.vote(h) == sum(1 << j for j in range(64) if 2 * bits[j] > len(h))


def test_links_in_hot_shards(spark):
    rng = random.Random(4)
    prints = sorted({*around(rng, 80, 4), *around(rng, 80, 5), *(rng.getrandbits(64) for _ in range(40))})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    want = classes({i: x for i, x in enumerate(prints)})
    place = {x: i for i, x in enumerate(prints)}
    for large in (2, 10, 4096):
        up = {i: i for i in range(len(prints))}
        edges = [(place[r.u % (1 << 64)], place[r.v % (1 << 64)]) for r in simhash.links(df, large).collect()]
        for _ in range(len(prints)):
            for a, b in edges:
                up[a] = up[b] = min(up[a], up[b])
        assert up == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (201, 200), (200, 201)]
    found = {r.u: r.v for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(6)]
    near = [(b + " Tail").replace(" w1 ", " W1\t") for b in base]
    return [(i, t) for i, t in enumerate([*base, *near, None, "", "  ", "one", "ONE", "one two", "x " * 4000, base[0]])]


def test_documents(spark):
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in rows()], "doc_id long, text string, fingerprint string, fp int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = {i: fingerprint(t) for i, t in rows()}
    want = classes(prints)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    kept = sorted(r.doc_id for r in simhash.keep_one(df).collect())
    assert kept == sorted(set(want.values()))
    assert simhash.keep_one(df).columns == df.columns


def test_null_ids_repeated_rows_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "q r s t u v"), (None, "q r s t u v")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 5), (5, 5), (5, 5)]
    assert sorted((r.doc_id or -1) for r in simhash.keep_one(df).collect()) == [-1, 5]
    assert simhash.near_duplicates(df.limit(0)).collect() == []
