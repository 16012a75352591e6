import numpy as np
from keelgrid.llm import simhash as s


def test_close_fingerprints_are_candidates_and_only_alike_sets_are_linked(spark, monkeypatch):
    """Without bands only the SimHash trees are left: they must find copies with a changed word in long texts."""
    monkeypatch.setattr(s, "bands", lambda h: [int(h[0]) ^ int(h[-1])] if len(h) else [])
    random = np.random.default_rng(4)
    texts = []
    for _ in range(6):
        words = [f"w{x}" for x in random.integers(0, 10**6, 3000)]
        texts += [" ".join(words), " ".join(["new", *words[1:]]), " ".join([*words[:-1], "end"])]
    texts += ["", "a b", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: set(s.shingle_hashes(x, s.WIDE).tolist()) for i, x in enumerate(texts)}
    own = s.shingle_sets(df).selectExpr("fingerprint as fp", "kg_print").distinct()
    of = {int(s.xxhash.xxh64_intdigest(np.unique(s.shingle_hashes(x, s.WIDE)).tobytes(), s.SEED).__index__()): i for i, x in enumerate(texts)}
    named = lambda v: of[v % (1 << 64)]
    pairs = {tuple(sorted((named(r.u), named(r.v)))) for r in s.print_pairs(own).collect()}
    bits = lambda i: s.vote(np.unique(s.shingle_hashes(texts[i], s.WIDE)))
    assert pairs and all((bits(a) ^ bits(b)).bit_count() <= s.RADIUS * 2 for a, b in pairs)
    joined = {x: x for x in range(18)}
    for _ in range(3):
        for a, b in pairs:
            joined[a] = joined[b] = min(joined.get(a, a), joined.get(b, b))
    for i in range(18):
        for j in range(i):
            if (bits(i) ^ bits(j)).bit_count() <= s.RADIUS:
                assert joined[i] == joined[j]
    kept = {r.doc_id for r in s.keep_one(df, least=0.8).collect()}
    for i in range(0, 18, 3):
        assert i in kept and len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8
    assert 18 in kept and 19 in kept and 20 not in kept
