"""Document fingerprints by winnowing: rolling hashes of k units, of each window of w of them the smallest, rightmost on ties.

Units are characters (chars=True, op4: CHAR_K of them in windows of CHAR_WINDOW, each lower-cased by itself, white space
included) or words (runs of characters that are not white space, lower-cased). Every shared run of at least k + w - 1
units is sure to share a selected hash, and the positions (unit numbers, from 0) of the selected hashes are kept. Scripts
without spaces have few words and need characters, where a shared run is found at any offset.

A unit has a 64-bit code (XXH64). The hash of k units is their codes shifted and combined by exclusive or, the cyclic
kind of rolling hash; hashes of 2, 4, ... units are made from those of half as many, so neighbours share their work. The
smallest of a window is told by 33 bits of its hash, and by the position where these are equal; the whole 64 bits are
kept. Which hash is the smallest depends on the window alone, so the guarantee does not rest on how many bits decide. k
and w are powers of two.

A text with fewer than k units has one k-gram of all its units; one with fewer than w k-grams is a single window. Null and
empty texts (in words: texts of white space too) have an empty fingerprint. Texts of any length are taken whole.

Likeness is the share of common hashes among all distinct hashes of the two; two empty fingerprints are alike (1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelgrid.llm.shared import BLOCK, let, next_blocks, with_blocks

K, WINDOW = 4, 8
CHAR_K, CHAR_WINDOW = 4, 4
#: The bits of a hash that decide, and those that hold a position below them.
_KEY, _LOW = ((1 << 33) - 1) << 30, (1 << 30) - 1


def _from(a: Column, k: int) -> Column:
    """The array without its first k."""
    return F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))


def _doubled(a: Column, upto: int, join, body, span: int = 1) -> Column:
    """body of the array whose element i joins elements i to i + upto - 1, each doubling joined from the last. Its last
    upto - 1 elements are of fewer."""
    if span == upto:
        return body(a)
    return let(F.zip_with(a, _from(a, span), lambda x, y: join(x, y, span)), lambda n: _doubled(n, upto, join, body, 2 * span))


def grams(text: Column, k: int = K, chars: bool = False) -> Column:
    """Array of the hashes of k consecutive words, or characters."""
    whole = F.coalesce(text, F.lit(""))
    if chars:
        # Lower case is one character for one and depends on no neighbour, but for these two letters.
        each = F.when(F.contains(whole, F.lit("\u03a3")) | F.contains(whole, F.lit("\u0130")), F.transform(F.split(whole, ""), lambda x: F.lower(x))).otherwise(F.split(F.lower(whole), ""))
        codes = F.when(whole == "", F.array().cast("array<bigint>")).otherwise(F.transform(each, lambda x: F.xxhash64(x)))
    else:
        codes = F.transform(F.regexp_extract_all(F.lower(whole), F.lit(r"\S+"), F.lit(0)), lambda x: F.xxhash64(x))
    roll = lambda x, y, span: F.shiftleft(x, span).bitwiseXOR(y)
    return let(
        codes,
        lambda c: F.when(F.size(c) >= k, _doubled(c, k, roll, lambda h: F.slice(h, 1, F.size(c) - k + 1)))
        .when(F.size(c) > 0, F.array(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: roll(a, x, 1))))
        .otherwise(c),
    )


def winnow(text: Column, k: int = K, window: int = WINDOW, chars: bool = False) -> Column:
    """Struct of arrays: hashes and positions of the selected k-grams, in the order of the text."""
    if k & (k - 1) or window & (window - 1):
        raise ValueError("k and window must be powers of two")

    def select(g: Column) -> Column:
        # The hash's bits less the position: the smallest is the smallest hash, rightmost on ties.
        order = F.transform(g, lambda x, i: x.bitwiseAND(F.lit(_KEY)) - i)
        chosen = _doubled(order, window, lambda x, y, _: F.least(x, y), lambda m: F.array_distinct(F.slice(m, 1, F.greatest(F.size(g) - window + 1, F.lit(1)))))
        places = F.transform(chosen, lambda x: (-x).bitwiseAND(F.lit(_LOW)).cast("int"))
        return let(places, lambda p: F.struct(F.transform(p, lambda i: F.get(g, i)).alias("hashes"), p.alias("positions")))

    return let(grams(text, k, chars), select)


def _upto(a: Column, most: Column) -> Column:
    """How many elements of an ascending array are `most` at most, by halving."""
    steps = [1 << k for k in range(29, -1, -1)]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when((at + s <= F.size(a)) & (F.get(a, at + s - 1) <= most), at + s).otherwise(at))


def joined(a: Column, b: Column, a_text: Column, b_text: Column, n: Column, m: Column, k: int, window: int) -> Column:
    """The fingerprint, in characters, of the first n of a_text and then the first m of b_text, from their fingerprints a and b.

    What whole windows inside either part select is taken over: a position that leaves room for a window after it is
    selected in the part as in the whole text. The windows that cross, and each part's last ones, are winnowed anew. Both
    parts must have k + 2 * window - 1 characters at least."""
    reach = k + window - 1
    tail = reach + window - 1
    last_a, last_b = n - reach, m - reach
    part = lambda s, at, size: F.substring(s, at + 1, size)
    crossing = winnow(F.concat(part(a_text, n - tail, F.lit(tail)), part(b_text, F.lit(0), F.lit(reach - 1))), k, window, True)
    ending = winnow(part(b_text, m - tail, F.lit(tail)), k, window, True)
    taken = F.struct(_upto(a["positions"], last_a).alias("a"), _upto(b["positions"], last_b).alias("b"), crossing.alias("x"), ending.alias("y"))

    def put(s: Column) -> Column:
        def new(f: Column, shift: Column, above: Column, below: Column | None = None) -> Column:
            at = F.transform(f["positions"], lambda p: p + shift)
            there = lambda e: (e["p"] > above) & (F.lit(True) if below is None else e["p"] < below)
            return F.filter(F.arrays_zip(at.alias("p"), f["hashes"].alias("h")), there)

        # Windows that cross select no position beyond the first that b's own windows select.
        between = new(s["x"], n - tail, last_a, n + b["positions"][0])
        after = new(s["y"], n + m - tail, n + last_b)
        return let(
            F.struct(between.alias("x"), after.alias("y")),
            lambda e: F.struct(
                F.concat(F.slice(a["hashes"], 1, s["a"]), e["x"]["h"], F.slice(b["hashes"], 1, s["b"]), e["y"]["h"]).alias("hashes"),
                F.concat(F.slice(a["positions"], 1, s["a"]), e["x"]["p"], F.transform(F.slice(b["positions"], 1, s["b"]), lambda p: p + n), e["y"]["p"]).alias("positions"),
            ),
        )

    return let(taken, put)


def kinds(print_: Column) -> Column:
    """How many different hashes a fingerprint has."""
    return F.size(F.array_distinct(print_["hashes"]))


def likeness(a: Column, b: Column, a_kinds: Column, b_kinds: Column) -> Column:
    """Of two fingerprints, with how many different hashes each has."""
    return let(
        F.size(F.array_intersect(a["hashes"], b["hashes"])),
        lambda common: F.when(a_kinds + b_kinds == 0, F.lit(1.0)).otherwise(common / (a_kinds + b_kinds - common)),
    )


def as_digest(print_: Column) -> Column:
    """32 hexadecimal digits that stand for all hashes and positions of a fingerprint."""
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), print_["hashes"], print_["positions"])), 16, "0")
    return F.lower(F.concat(half(1), half(2)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW, chars: bool = False) -> DataFrame:
    """id, and the fingerprint as a struct of hashes and positions; a narrow projection."""
    return df.select(id_col, winnow(F.col(text_col), k, window, chars).alias("fingerprint"))


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW, width: int = BLOCK, chars: bool = False) -> DataFrame:
    """Fingerprints of each text and of its edited text (the last half, rounded down, of its code points replaced by as
    many first code points of the next document, in ascending order of ids; after the last: the first), and likenesses.

    Returns the id, n_chars, edited_sha256, the two fingerprints as structs, near_edited, near_next. Ids are integers; a
    null id comes before all, rows of one id are ordered by the hash of the text. A single document follows itself.
    Other columns are ignored; an empty table gives no rows.

    Rows are cut into blocks of about `width` by ranges of ids (with_blocks), null ids by ranges of the text's hash; rows
    that repeat one id stay together. A block is what one task orders. The texts are shuffled once, by block; both
    readers below share that exchange. A block's last row gets the first row of the next block over a join of one row a
    block. In characters each text is winnowed once: the edited text's fingerprint is put together from its parts'."""
    base = df.select(F.col(f"`{id_col}`").alias("kg_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("kg_text"))
    base = with_blocks(base, "kg_id", F.shiftright(F.xxhash64("kg_text"), 52) + 2048, "kg_block", width)
    ring = next_blocks(base.select(F.col("kg_block").alias("kg_b")).distinct(), "kg_b")
    base = base.repartition("kg_block")
    order = Window.partitionBy("kg_block").orderBy(F.asc_nulls_first("kg_id"), F.xxhash64("kg_text"))
    print_ = winnow(F.col("kg_text"), k, window, chars).alias("kg_print")
    ahead = F.struct("kg_text", "kg_print", kinds(F.col("kg_print")).alias("kinds"))
    rows = base.select("kg_id", "kg_text", "kg_block", print_).withColumn("kg_own", ahead)
    rows = rows.select("kg_id", "kg_own", "kg_block", F.lead("kg_own").over(order).alias("kg_inside"))
    heads = base.select("*", F.row_number().over(order).alias("kg_row")).where("kg_row = 1").select("kg_block", "kg_text", print_)
    heads = heads.join(ring, F.col("kg_block") == F.col("kg_next")).select(F.col("kg_b").alias("kg_asks"), ahead.alias("kg_outside"))
    met = rows.join(heads, (F.col("kg_block") == F.col("kg_asks")) & F.col("kg_inside").isNull(), "left")
    met = met.select("kg_id", "kg_own.kg_text", "kg_own.kg_print", "kg_own.kinds", F.length("kg_own.kg_text").alias("kg_n"), F.coalesce("kg_inside", "kg_outside").alias("kg_after"))
    met = met.withColumn("kg_half", F.floor(F.col("kg_n") / 2).cast("int"))
    edited = F.concat(F.substring(F.col("kg_text"), F.lit(1), F.col("kg_n") - F.col("kg_half")), F.substring(F.col("kg_after.kg_text"), F.lit(1), F.col("kg_half")))

    def edited_print(e: Column) -> Column:
        anew = winnow(e, k, window, chars)
        if not chars:
            return anew
        own, new = F.col("kg_n") - F.col("kg_half"), F.length(e) - (F.col("kg_n") - F.col("kg_half"))
        enough = F.lit(k + 2 * window - 1)
        parts = joined(F.col("kg_print"), F.col("kg_after.kg_print"), F.col("kg_text"), F.col("kg_after.kg_text"), own, new, k, window)
        return F.when((own >= enough) & (new >= enough), parts).otherwise(anew)

    after = F.struct("kg_after.kg_print", "kg_after.kinds")
    done = met.select("kg_id", "kg_n", "kg_print", "kinds", after.alias("kg_near"), let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), edited_print(e).alias("print"))).alias("kg_edited"))
    return done.select(
        F.col("kg_id").alias(id_col),
        F.col("kg_n").cast("long").alias("n_chars"),
        F.col("kg_edited.sha").alias("edited_sha256"),
        F.col("kg_print").alias("fingerprint"),
        F.col("kg_edited.print").alias("edited_fingerprint"),
        likeness(F.col("kg_print"), F.col("kg_edited.print"), F.col("kinds"), kinds(F.col("kg_edited.print"))).alias("near_edited"),
        likeness(F.col("kg_print"), F.col("kg_near.kg_print"), F.col("kinds"), F.col("kg_near.kinds")).alias("near_next"),
    )
