"""Secrets against Python's own matching and numbers, and planted random strings among words."""

import hashlib
import math
import random
import re

import pytest
from keelgrid.llm import secrets

KINDS = ("assign", "access", "hex", "random")
PLAIN = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def base(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(PLAIN) for m in p.finditer(text or "") if len(m[g]) >= n]
    return [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def deviates(codes, k):
    n = len(codes)
    chi = (sum(codes.count(c) ** 2 for c in range(k)) * k / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    side = [c >= k / 2 for c in codes]
    runs, high = 1 + sum(a != b for a, b in zip(side, side[1:], strict=False)), sum(side)
    mixed = 2 * high * (n - high)
    spread = math.sqrt(max(0, mixed * (mixed - n) / (n * n * (n - 1))))
    run = (runs - mixed / n - 1) / spread if spread else 40
    total, square = sum(codes), sum(c * c for c in codes)
    product = sum(codes[i] * codes[(i + 1) % n] for i in range(n))
    scale = n * square - total * total
    serial = ((n * product - total * total) / scale + 1 / (n - 1)) * (n - 1) * math.sqrt(n - 2) / n if scale else 40
    return chi, run, serial


def plain_p(token):
    bare = token.rstrip("=")
    kind = next(i for i, (_, a) in enumerate(secrets.ENCODINGS) if set(bare) <= set(a))
    alphabet = secrets.ENCODINGS[kind][1]
    least = min(math.erfc(min(40, abs(z)) / math.sqrt(2)) for z in deviates([alphabet.index(c) for c in bare], len(alphabet)))
    return kind, len(bare), 1 - (1 - least) ** 3


TEXTS = [
    None,
    "",
    " ",
    "password: token: abcdefghijklmnopqrst",
    "API_KEY='abcdefghijkl' apikey = \"short\" Secret:abcdefghijklm.token=xyz0123456789",
    "é😀 AKIAABCDEFGHIJKLMN x AKIAAKIAA 0123456789abcdef 0123456789abcdeg deadbeefdeadbeefdeadbeef",
    "ſecret=abcdefghijklmnop toKen = abcdefghijklmnop",
    "a0" * 5000 + " x " + "password=" * 50,
    "😀" * 70 + " ".join("0123456789abcdef%02x" % i for i in range(100)),
]


def test_base_spans_are_pythons(spark):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[4]), (4, TEXTS[4])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, n_hex int")
    got = sorted(((r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex, r.spans) for r in secrets.find_secrets(df).collect()), key=repr)
    want = []
    for i, t in rows:
        b = base(t)
        want.append((i, hashlib.sha256(",".join(b).encode()).hexdigest(), *(sum(x.startswith(k) for x in b) for k in KINDS[:3]), b))
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:5] == w[:5]
        assert [s for s in g[5].split(",") if s and not s.startswith("random")] == w[5]


def test_a_run_of_a_million_characters_and_many_matches(spark):
    text = "b" * 1_000_000 + " " + " ".join(["0123456789abcdef"] * 20_000)
    row = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_hex, row.spans) == (20_001, ",".join(base(text)))


def test_randomness_is_the_plain_computation(spark):
    rng = random.Random(5)
    tokens = ["".join(rng.choices(a, k=n)) for _, a in secrets.ENCODINGS for n in (20, 33, 64)]
    tokens += ["a" * 30, "abcdefghijklmnopqrstuvwxyz", "internationalization", "Zz" * 20 + "==", "ABCD" * 9]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select(secrets.randomness(secrets.F.col("t")).alias("r")).collect()
    for t, r in zip(tokens, got, strict=True):
        kind, n, p = plain_p(t)
        assert (r.r.kind, r.r.n) == (kind, n)
        assert r.r.p == pytest.approx(p, abs=1e-5)


def test_random_strings_are_found_and_words_are_not(spark):
    """Planted: a hundred random strings of four encodings, and names put together from words."""
    rng = random.Random(11)
    words = "the request handler configuration manager internal service provider abstract factory default value response document".split()
    b64, b32, hexa = (dict((n, a) for n, a in secrets.ENCODINGS)[k] for k in ("base64", "base32", "HEX"))
    secret = ["".join(rng.choices(a, k=n)) for a, n in ((b64, 40), (b32, 48), (hexa, 64), (b64, 86)) for _ in range(25)]
    plain = ["".join(w.title() for w in rng.choices(words, k=4)) for _ in range(300)] + ["_".join(rng.choices(words, k=4)) for _ in range(300)] + ["".join(rng.choices(words, k=4)) for _ in range(300)]
    rows = [(i, f"see {t} here") for i, t in enumerate(secret + plain)]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [i for i, s in got.items() if "random" in s]
    assert sum(i < 100 for i in found) >= 95
    assert sum(i >= 100 for i in found) <= 0.05 * len(found)
    assert all(got[i] == f"random:4:{4 + len(secret[i])}" for i in found if i < 100 and "," not in got[i])


def test_native_and_empty(spark):
    df = spark.createDataFrame([], "doc_id string, text string, `a.b` int")
    out = secrets.find_secrets(df)
    assert out.collect() == [] and out.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert not re.search("Python|Arrow|Pandas", secrets.find_secrets(spark.createDataFrame([("x", "y")], "doc_id string, text string"))._jdf.queryExecution().executedPlan().toString())
