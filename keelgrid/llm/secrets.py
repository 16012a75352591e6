"""Secrets in texts: three patterns, and a battery of randomness tests for what no pattern names.

Base spans are the matches of BASE, leftmost and not overlapping per kind; a match that is too short is dropped after it
has been consumed. Letters match in either case where the pattern says so, A-Z and a-z only.

The method looks at every other run of LEAST or more characters of base64's alphabets. The run's encoding is the smallest
of ENCODINGS that holds all its characters (trailing = are padding). Three tests ask whether it can be drawn at random from
that alphabet: chi-squared uniformity of the alphabet's characters, the number of runs above and below the alphabet's
middle, and the serial correlation of neighbours. Each gives a normal deviate and a two-sided p; the least of the three,
corrected for being the least of three (Sidak), is the run's p: spread over 0 to 1 for random strings, near 0 for words.

Which p is large enough depends on the length: short words often pass. So different runs are counted over the whole corpus
by encoding and length band, in BINS classes of p, and each such stratum gets its own cut. What an ordinary string of the
band's shortest length would do is worked out from the coincidence rate of written language (COINCIDENCE, more where an
alphabet has fewer letters): the chi-squared deviate is shifted by what that rate adds to it. That gives the share of
ordinary strings that pass a cut; with the share of all runs above p = 0.5 it gives the share of random ones (Storey's
estimate, corrected for the tests' power). What passes a cut and is ordinary by that share, or is more than the random runs
explain, is false. The cut is the lowest at which the false are at most RATE of what passes; where there is none, the
stratum adds nothing. Runs of digits alone are never added: ordinary numbers look as random ones do.

A run inside a base span adds nothing. Null and empty texts have no spans. Repeated rows get equal rows, and their runs
count once. Null ids stay. Other columns, whatever their names, are ignored. An empty table gives no rows. Everything is
column expressions; nothing but hashes and classes of runs is shuffled, and the driver gets the strata's counts, at most
len(ENCODINGS) * BANDS * BINS numbers.
"""

from __future__ import annotations

import math
from collections import defaultdict
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelgrid.llm.shared import let, named, staged

#: Kinds in order, pattern, the group whose length counts, and the least such length (fixed values).
BASE = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Where a maximal run is the match, a run of the least length is the same match, and the short ones are not made.
_LONG = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
_RUN, LEAST, KIND = r"[A-Za-z0-9+/_-]{20,}={0,2}", 20, "random"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Name, alphabet in the order of its codes; the smaller come first.
ENCODINGS = (
    ("decimal", _DIGITS),
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("lower", _LOWER),
    ("upper", _UPPER),
    ("base32", _UPPER + "234567"),
    ("lower36", _DIGITS + _LOWER),
    ("upper36", _DIGITS + _UPPER),
    ("alphanumeric", _UPPER + _LOWER + _DIGITS),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
    ("any", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
#: Length bands: half octaves from LEAST on; the last holds all longer runs. Classes of p, and the false share allowed.
BANDS, BINS, RATE, COINCIDENCE = 24, 100, 0.05, 0.065


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of the pattern's matches, in code points, end exclusive.

    The pieces between matches and the matches make up the text in turn; their running sums, taken by doubling steps (as
    many as the logarithm of their number), are the places."""
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def places(b: Column) -> Column:
        steps = F.zip_with(F.slice(b["gaps"], F.lit(1), F.size(b["found"])), b["found"], lambda g, m: F.length(g) + F.length(m))
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(b["found"]).cast("double"))).cast("int"))
        ends = F.aggregate(rounds, steps, lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2.0), k).cast("int")), F.lit(0))))
        return F.zip_with(ends, b["found"], lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("found")))

    return F.coalesce(F.when(text.rlike(pattern), let(both, places)), F.array().cast("array<struct<start:int,end:int,found:string>>"))


def _spans(text: Column, number: int) -> Column:
    kind, pattern, group, least = BASE[number]
    found = matches(text, _LONG.get(kind, pattern))
    if group:
        found = F.filter(found, lambda m: F.length(F.regexp_extract(m["found"], pattern, group)) >= least)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Array of (start, kind's number, end) of the base spans, by start, then kind."""
    return F.array_sort(F.concat(*(_spans(text, k) for k in range(len(BASE)))))


def _upper_tail(z: Column) -> Column:
    """The standard normal's upper tail for z >= 0, by a polynomial times the density (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def _deviates(codes: Column, k: Column) -> list[Column]:
    """Normal deviates of the three tests, for an array of codes below k (a double column)."""
    n = F.size(codes).cast("double")
    add = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    squares = F.aggregate(F.sequence(F.lit(0), k.cast("int") - 1), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(codes, lambda x: x == c)), F.lit(2.0)))
    chi = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    after = F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(1)))
    high = add(codes, lambda x: (x >= k / 2).cast("double"))
    runs = 1 + add(F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), after, lambda a, b: ((a >= k / 2) != (b >= k / 2)).cast("double")), lambda x: x)
    mixed = 2 * high * (n - high)
    spread = F.sqrt(F.greatest(mixed * (mixed - n) / (n * n * (n - 1)), F.lit(0.0)))
    # One value on one side at most: as far from a random string as can be.
    run = F.when(spread > 0, (runs - mixed / n - 1) / F.when(spread > 0, spread)).otherwise(40.0)
    total, square = add(codes, lambda x: x.cast("double")), add(codes, lambda x: (x * x).cast("double"))
    product = add(F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), after, lambda a, b: (a * b).cast("double")), lambda x: x) + (codes[0] * F.element_at(codes, -1)).cast("double")
    scale = n * square - total * total
    serial = F.when(scale > 0, ((n * product - total * total) / F.when(scale > 0, scale) + 1 / (n - 1)) * (n - 1) * F.sqrt(n - 2) / n).otherwise(40.0)
    return [chi, run, serial]


def randomness(token: Column) -> Column:
    """(encoding's number, length without padding, p) of a run of base64 characters."""
    bare = F.regexp_replace(token, "=+$", "")
    kind = F.lit(len(ENCODINGS) - 1)
    for i in reversed(range(len(ENCODINGS) - 1)):
        kind = F.when(bare.rlike("^[" + ENCODINGS[i][1].replace("-", r"\-") + "]*$"), i).otherwise(kind)
    alphabets = F.array(*(F.lit(a) for _, a in ENCODINGS))

    def coded(x: Column) -> Column:
        codes = F.transform(F.split(x["bare"], ""), lambda c: F.instr(x["alphabet"], c) - 1)
        return F.struct(x["kind"].alias("kind"), codes.alias("codes"), F.length(x["alphabet"]).cast("double").alias("k"))

    def tested(x: Column) -> Column:
        tails = F.transform(F.array(*_deviates(x["codes"], x["k"])), lambda z: 2 * _upper_tail(F.least(F.abs(z), F.lit(40.0))))
        return F.struct(x["kind"].alias("kind"), F.size(x["codes"]).alias("n"), (1 - F.pow(1 - F.least(F.array_min(tails), F.lit(1.0)), F.lit(3.0))).alias("p"))

    known = let(F.struct(bare.alias("bare"), kind.alias("kind")), lambda x: F.struct(x["bare"].alias("bare"), x["kind"].alias("kind"), F.get(alphabets, x["kind"]).alias("alphabet")))
    return let(let(known, coded), tested)


def _band(n: Column) -> Column:
    """Half octaves from LEAST on."""
    return F.least(F.greatest(F.floor(2 * F.log2(n / F.lit(float(LEAST)))), F.lit(0)), F.lit(BANDS - 1)).cast("int")


def cut_off(counts: list[int], kind: int, band: int, rate: float = RATE) -> float | None:
    """The least p that passes in a stratum, from its numbers of different runs by class of p; None if nothing may."""
    alphabet, n, normal = ENCODINGS[kind][1], LEAST * 2 ** (band / 2), NormalDist()
    k, letters = len(alphabet), len({c for c in alphabet.lower() if c.isalpha()})
    shift = (n - 1) * (k * COINCIDENCE * 26 / max(1, letters) - 1) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    total = sum(counts)
    if kind == 0 or not total:
        return None

    def ordinary(p: float) -> float:
        """Share of ordinary strings above p, by the chi-squared test alone."""
        return normal.cdf(-normal.inv_cdf((1 - (1 - p) ** (1 / 3)) / 2) - shift)

    above = [sum(counts[i:]) for i in range(BINS + 1)]
    half = above[BINS // 2] / total
    random_share = min(1.0, max(0.0, (half - ordinary(0.5)) / (0.5 - ordinary(0.5)))) if ordinary(0.5) < 0.5 else 0.0
    several = random_share * total
    for i in range(1, BINS):
        # What passes must not be more than the random runs explain, within the error of their number.
        unexplained = above[i] - several * (1 - i / BINS) - math.sqrt(several)
        if above[i] and max(unexplained, (total - several) * ordinary(i / BINS)) <= rate * above[i]:
            return i / BINS
    return None


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The id, n_assign, n_access, n_hex (long), base_sha256 and spans (kind:start:end by start, then kind, comma-joined)."""
    text = F.coalesce(named(text_col), F.lit(""))
    found = df.select(named(id_col).alias("kg_id"), text.alias("kg_text"))
    found = found.select("kg_id", base_spans(F.col("kg_text")).alias("kg_base"), matches(F.col("kg_text"), _RUN).alias("kg_runs"))
    outside = F.filter("kg_runs", lambda m: ~F.exists("kg_base", lambda b: (b["start"] <= m["start"]) & (b["end"] >= m["end"])))

    def judged(m: Column) -> Column:
        return let(
            randomness(m["found"]),
            lambda r: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.xxhash64(m["found"]).alias("hash"), r["kind"].alias("kind"), _band(r["n"]).alias("band"), r["p"].alias("p")),
        )

    found = staged(found.select("kg_id", "kg_base", F.transform(outside, judged).alias("kg_runs")), "secrets")
    runs = found.select(F.explode("kg_runs").alias("r")).select("r.kind", "r.band", F.least(F.floor(F.col("r.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), "r.hash")
    strata: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0] * BINS)
    for kind, band, at, n in runs.distinct().groupBy("kind", "band", "bin").count().collect():
        strata[kind, band][at] = n
    least = {key: cut for key, counts in strata.items() if (cut := cut_off(counts, *key, rate)) is not None}
    cut = F.array(*(F.lit(least.get((k, b), 2.0)) for k in range(len(ENCODINGS)) for b in range(BANDS)))
    passing = F.filter("kg_runs", lambda r: r["p"] >= F.get(cut, r["kind"] * BANDS + r["band"]))
    added = F.transform(passing, lambda r: F.struct(r["start"].alias("start"), F.lit(len(BASE)).alias("kind"), r["end"].alias("end")))
    kinds = F.array(*(F.lit(b[0]) for b in BASE), F.lit(KIND))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("kg_base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("kg_id").alias(id_col), *(number(k).alias(f"n_{b[0]}") for k, b in enumerate(BASE)), F.sha2(told(F.col("kg_base")).cast("binary"), 256).alias("base_sha256"), told(F.array_sort(F.concat("kg_base", added))).alias("spans")
    )
