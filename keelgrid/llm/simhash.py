"""SimHash near-duplicates: 64-bit fingerprints, BK-trees for the search, connected components for the classes.

A-Z are lower-cased, words are runs of bytes other than ASCII white space, shingles are 3 words joined by spaces, repeats
included (fewer words: the whole sequence; none, null included: fingerprint 0). A bit of the fingerprint is 1 if it is set in over
half of the shingles' XXH64 (seed 42). Fingerprints at most 2 bits apart are linked; a document's component_id is the
smallest id it reaches. Fingerprint 0 is linked like any other.

Only different fingerprints are compared, so any number of copies is one row. The 64 bits are cut into 4 blocks of 16; two
fingerprints at most 2 bits apart agree on 2 blocks at least, so each goes to 6 shards, one for each pair of blocks, and
all links lie inside shards. A shard's BK-tree (children keyed by their Hamming distance to the parent; only edges
within the radius are followed) is built where its members meet, and all of them are searched for together: each node of
the tree is visited once, with the members that can be near it. A whole-corpus tree is not broadcast, because its size
grows with the data. Shards with more than LARGE members are cut again in the same way on the other 32 bits. A shard gives
the edges of a forest only, fewer than its members; no list of pairs is made and nothing is collected.

A null id is a document that no id names: it gets the smallest id it reaches, null if there is none. Repeated rows are
copies. Other columns are ignored. An empty table gives no rows.

keep_one takes a least likeness instead: then documents are linked whose sets of 5-word shingles (made and hashed as above)
have that Jaccard index at least, counted exactly. The first candidates are those whose sets' SimHashes the same BK-trees link. 2 of
64 bits can't find all such pairs (at 0.8 they differ in up to 14 bits and more), so texts that agree on one of BANDS bands of
ROWS min-hashes are candidates too: a pair of likeness 0.8 is missed with
a chance of 6 in 10^5, one of 0.85 with 3 in 10^7. Texts of equal sets are one candidate. Each text is first compared with
two others at most, heads of its buckets: of a bucket's texts the head is the one that meets most others in all its
buckets, so that the copies of a text meet that text. Of the texts that are then in different classes, those of a
bucket are compared whose numbers of common shingles (those that more than RARE of the open texts have) allow the
likeness, and those that share a rarer one: of two alike texts either is true. Texts of one class are not paired with each
other, and of those with the same common shingles one meets the other classes, so copies of one template, with edits of
their own, cost in proportion to their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelgrid.llm.components import connected_components
from keelgrid.llm.shared import named, portions, staged

SHINGLE, SEED, RADIUS, LARGE = 3, 42, 2, 4096
WIDE, BANDS, ROWS, RARE, PARTS = 5, 32, 6, 32, 64
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: For each byte, its bits in eight lanes of 8 bits, which hold sums of up to 255.
_LANES = np.packbits(np.zeros((256, 64), np.uint8), axis=1).view(np.uint64).ravel().copy()
for _b in range(256):
    _LANES[_b] = int.from_bytes(bytes((_b >> k) & 1 for k in range(8)), "little")


def shingle_hashes(text: str, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    w = text.encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(w) < size:
        return np.array([digest(b" ".join(w), seed)], np.uint64)
    return np.array([digest(b" ".join(x), seed) for x in zip(*(w[i:] for i in range(size)), strict=False)], np.uint64)


def vote(h: np.ndarray) -> int:
    """Each bit that is set in over half of the hashes."""
    if not len(h):
        return 0
    sums = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 * 256):
        lanes = _LANES[h[at : at + 255 * 256].view(np.uint8).reshape(-1, 8)]
        sums += np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > len(h), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id, kg_hash (of the text) and fingerprint (long, two's complement)."""
    schema = T.StructType([df.schema[id_col], T.StructField("kg_hash", T.LongType()), T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in portions(batches, "kg_text", 1_000_000):
            found = np.array([vote(shingle_hashes(x, size, seed)) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found)], names=schema.names)

    return df.select(named(id_col).alias("kg_id"), F.xxhash64(named(text_col)).alias("kg_hash"), named(text_col).alias("kg_text")).mapInArrow(run, schema)


def bk_links(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (places in members, which differ) of a forest that joins all members within the radius, found by a BK-tree.

    A subtree is the array of its members in the order in which they came; its root is the first, and its children are
    the others grouped by their distance to it. The queries that reach a subtree go on to the children whose
    distance differs from theirs by the radius at most."""
    n = len(members)
    label = np.arange(n)
    groups: dict[int, list[int]] = {}
    links: list[tuple[int, int]] = []
    work = [(np.arange(n), np.arange(n))]
    while work:
        tree, queries = work.pop()
        root = int(tree[0])
        to_root = np.bitwise_count(members[queries] ^ members[root])
        for q in queries[(to_root <= radius) & (label[queries] != label[root])].tolist():
            a, b = int(label[root]), int(label[q])
            if a == b:
                continue
            links.append((root, q))
            small, big = (a, b) if len(groups.get(a, (a,))) <= len(groups.get(b, (b,))) else (b, a)
            moved = groups.pop(small, [small])
            groups.setdefault(big, [big]).extend(moved)
            label[moved] = big
        rest = tree[1:]
        if len(rest):
            edge = np.bitwise_count(members[rest] ^ members[root])
            for d in np.unique(edge).tolist():
                go = queries[np.abs(to_root.astype(np.int16) - d) <= radius]
                if len(go):
                    work.append((rest[edge == d], go))
    return links


def _masks(bits: list[int], parts: int = 4) -> list[int]:
    """Masks of each pair of parts of these bit places."""
    size = len(bits) // parts
    block = [sum(1 << b for b in bits[i * size : (i + 1) * size]) for i in range(parts)]
    return [block[i] | block[j] for i in range(parts) for j in range(i)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MASKS = _masks(list(range(64)))
FINER = [m | f for m in MASKS for f in _masks([b for b in range(64) if not m >> b & 1])]


def _sharded(prints: DataFrame, masks: list[int]) -> DataFrame:
    """(shard, value, fp): the mask's number, and the bits it keeps."""
    keys = F.array(*(F.struct(F.lit(i).alias("shard"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in enumerate(masks)))
    return prints.select("fp", F.explode(keys).alias("k")).select("k.shard", "k.value", "fp")


def links(prints: DataFrame, large: int = LARGE) -> DataFrame:
    """Edges (u, v) between different fingerprints (column fp), enough to join all that are linked."""
    members = _sharded(prints, MASKS)
    sizes = members.groupBy("shard", "value").agg(F.count("*").alias("n")).where("n > 1").select(F.col("shard").alias("s"), F.col("value").alias("x"), "n")
    met = staged(members.join(sizes, (F.col("shard") == F.col("s")) & (F.col("value") == F.col("x"))).select("shard", "value", "fp", "n"), "shards")
    small = met.where(F.col("n") <= large).select("shard", "value", "fp")
    hot = met.where(F.col("n") > large)
    each = len(FINER) // len(MASKS)
    finer = F.array(*(F.struct(F.lit(i).alias("f"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(FINER)))
    hot = hot.select("fp", F.explode(F.slice(finer, F.col("shard") * each + 1, each)).alias("k"))
    hot = hot.select((F.lit(len(MASKS)) + F.col("k.f")).alias("shard"), F.col("fp").bitwiseAND(F.col("k.m")).alias("value"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(shard: np.ndarray, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero((shard[1:] != shard[:-1]) | (value[1:] != value[:-1])) + 1
            u, v = [], []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(fp)], strict=True):
                if b - a > 1:
                    for i, j in bk_links(fp[a:b]):
                        u.append(fp[a + i])
                        v.append(fp[a + j])
            return pa.RecordBatch.from_arrays([pa.array(np.array(u, np.uint64).view(np.int64)), pa.array(np.array(v, np.uint64).view(np.int64))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py()
            if (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) == last:
                continue  # all of one shard so far
            shard, value, fp = _columns(held)
            end = len(fp) - int(np.argmax((shard[::-1] != last[0]) | (value[::-1] != last[1])))
            yield found(shard[:end], value[:end], fp[:end])
            held = [_batch(shard[end:], value[end:], fp[end:])]
        if held:
            yield found(*_columns(held))

    def in_shards(df: DataFrame) -> DataFrame:
        return df.repartition("shard", "value").sortWithinPartitions("shard", "value", "fp").mapInArrow(run, "u long, v long")

    return in_shards(small.unionByName(hot)).distinct()


def _columns(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(batches)
    return t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy().view(np.uint64)


def _batch(shard: np.ndarray, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(value), pa.array(fp.view(np.int64))], names=["shard", "value", "fp"])


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: the rows' fingerprints (written), and for each different fingerprint (kg_fp) its class (kg_root, the
    smallest fingerprint in it) and the class's smallest id (component_id)."""
    prints = staged(fingerprints(df, id_col, text_col), "fingerprints")
    own = staged(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(named(id_col)).alias("kg_least")), "different")
    return prints, _rooted(own, links(own.select("fp")))


def _rooted(own: DataFrame, edges: DataFrame) -> DataFrame:
    """The second table of classes, from (fp, kg_least) and the edges between fingerprints."""
    stars = connected_components(edges).select(F.col("u").alias("kg_u"), F.col("v").alias("kg_v"))
    rooted = own.join(stars, F.col("fp") == F.col("kg_u"), "left").select("fp", "kg_least", F.coalesce("kg_v", "fp").alias("kg_root"))
    smallest = rooted.groupBy(F.col("kg_root").alias("kg_r")).agg(F.min("kg_least").alias("component_id"))
    return rooted.join(smallest, F.col("kg_root") == F.col("kg_r")).select(F.col("fp").alias("kg_fp"), "kg_root", "component_id")


def bands(h: np.ndarray) -> list[int]:
    """One hash for each band of the set's min-hashes; of an empty set none."""
    if not len(h):
        return []
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(h), 1024):
        np.minimum(least, (h[at : at + 1024] * _FACTORS).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def shingle_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WIDE) -> DataFrame:
    """id, kg_hash (of the text), fingerprint (the hash of the set of shingles), kg_size (of the set), kg_print (its SimHash) and
    kg_bands (an array), all long."""
    schema = T.StructType([df.schema[id_col], T.StructField("kg_hash", T.LongType()), T.StructField("fingerprint", T.LongType()), T.StructField("kg_size", T.LongType()), T.StructField("kg_print", T.LongType()), T.StructField("kg_bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in portions(batches, "kg_text", 1_000_000):
            prints, sizes, votes, lists = [], [], [], []
            for x in texts:
                h = np.unique(shingle_hashes(x, size))
                prints.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                sizes.append(len(h))
                votes.append(vote(h))
                lists.append(np.array(bands(h), np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(votes, np.uint64).view(np.int64)), pa.array(lists, pa.list_(pa.int64()))], names=schema.names)

    return df.select(named(id_col).alias("kg_id"), F.xxhash64(named(text_col)).alias("kg_hash"), named(text_col).alias("kg_text")).mapInArrow(run, schema)


def _members(texts: DataFrame, size: int = WIDE) -> DataFrame:
    """From (kg_text, fp): fp and kg_set, the hashes of the text's set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in portions(batches, "kg_text", 1_000_000):
            sets = [np.unique(shingle_hashes(x, size)).view(np.int64) for x in found]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "kg_set"])

    return texts.select("kg_text", "fp").mapInArrow(run, "fp long, kg_set array<long>")


def _order(id_col: str) -> Column:
    return F.struct(named(id_col).isNull().alias("a"), named(id_col).alias("b"), F.col("kg_hash").alias("c"))


def alike(df: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", size: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """As classes, but a fingerprint is the hash of a set of shingles, and sets of a Jaccard index of `least` at least are linked."""
    prints = staged(shingle_sets(df, id_col, text_col, size), "sets")
    own = staged(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(_order(id_col)).alias("kg_first"), F.min(named(id_col)).alias("kg_least"), F.first("kg_size").alias("size"), F.first("kg_print").alias("kg_print"), F.first("kg_bands").alias("kg_bands")), "different")
    close = staged(print_pairs(own), "close")
    each = own.select("fp", "size", F.posexplode("kg_bands").alias("band", "value"))
    filled = each.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1").select(F.col("band").alias("b"), F.col("value").alias("x"), "n")
    met = staged(each.join(filled, (F.col("band") == F.col("b")) & (F.col("value") == F.col("x"))).select("band", "value", "fp", "size", "n"), "buckets")
    meets = met.groupBy(F.col("fp").alias("of")).agg(F.sum("n").alias("meets"))
    heads = met.join(meets, F.col("fp") == F.col("of")).groupBy(F.col("band").alias("b"), F.col("value").alias("x")).agg(F.max(F.struct("meets", "fp", "size")).alias("head"))
    may = lambda a, b: (a >= F.lit(least) * b) & (b >= F.lit(least) * a)
    pairs = met.join(heads, (F.col("band") == F.col("b")) & (F.col("value") == F.col("x"))).where((F.col("head.fp") != F.col("fp")) & may(F.col("head.size"), F.col("size")))
    pairs = pairs.groupBy(F.col("head.fp").alias("u"), F.col("fp").alias("v")).agg(F.count("*").alias("c"), F.max("head.meets").alias("meets")).groupBy("v").agg(F.max(F.struct("c", "u")).alias("best"), F.max(F.struct("meets", "u")).alias("central"))
    pairs = pairs.select(F.explode(F.array_distinct(F.array("best.u", "central.u"))).alias("u"), "v").unionByName(close).distinct()
    # One row's text stands for each set that shares a bucket or is near by its SimHash.
    met_fps = met.select("fp").unionByName(close.select(F.explode(F.array("u", "v")).alias("fp"))).distinct()
    asked = staged(own.join(met_fps, "fp", "left_semi").select("fp", F.col("kg_first.b").alias("kg_id"), F.col("kg_first.c").alias("kg_key")), "asked")
    texts = df.select(named(id_col).alias("own_id"), F.xxhash64(named(text_col)).alias("own_key"), named(text_col).alias("kg_text"))
    texts = texts.join(asked, F.col("own_id").eqNullSafe(F.col("kg_id")) & (F.col("own_key") == F.col("kg_key")))
    sets = staged(_members(texts, size).dropDuplicates(["fp"]), "members")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("kg_set").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("kg_set").alias("b")), "v")
        counted = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("common"), (F.size("a") + F.size("b")).alias("sum"))
        return counted.where(F.col("common") / (F.col("sum") - F.col("common")) >= least).select("u", "v")

    near = staged(confirmed(pairs), "confirmed")
    joined = connected_components(near).select(F.col("u").alias("kg_u"), F.col("v").alias("kg_v"))
    now = met.join(joined, F.col("fp") == F.col("kg_u"), "left").select("band", "value", "fp", "size", F.coalesce("kg_v", "fp").alias("root"))
    # Only buckets of several classes go on.
    several = now.groupBy(F.col("band").alias("b"), F.col("value").alias("x")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("b", "x")
    now = staged(now.join(several, (F.col("band") == F.col("b")) & (F.col("value") == F.col("x"))).select("band", "value", "fp", "size", "root"), "open")
    texts = now.select("fp", "size", "root").distinct()
    each = sets.join(texts, "fp").select("fp", "size", "root", F.explode("kg_set").alias("shingle"))
    each = each.join(each.groupBy(F.col("shingle").alias("s")).agg(F.count("*").alias("n")), F.col("shingle") == F.col("s"))
    left = lambda df: df.withColumnsRenamed({c: f"kg_{c}" for c in _FACTS})
    apart = (F.col("kg_fp") < F.col("fp")) & (F.col("kg_root") != F.col("root")) & may(F.col("kg_size"), F.col("size"))
    enough = lambda most: most >= F.lit(least) * (F.col("kg_size") + F.col("size") - most)
    # A text's common shingles, counted by PARTS ranges of hashes: two texts share no more of a range than the fewer there.
    counts = each.where(F.col("n") > RARE).groupBy("fp", F.pmod("shingle", F.lit(PARTS)).cast("int").alias("part"))
    counts = counts.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("shingle")).alias("h1"), F.bit_xor(F.xxhash64("shingle", F.lit(1))).alias("h2"))
    counts = counts.groupBy(F.col("fp").alias("f")).agg(F.sum("n").alias("common"), F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("m"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    counts = counts.select("f", "common", "h1", "h2", F.transform(F.lit(list(range(PARTS))), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0))).alias("parts"))
    fewer = F.aggregate(F.zip_with("parts", "kg_parts", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda a, x: a + x)
    now = now.select("band", "value", "fp", "size", "root").join(counts, F.col("fp") == F.col("f")).where(F.col("common") >= F.lit(least) * F.col("size"))
    # Of a class's texts with the same common shingles and size one stands for all: what else they share is rare.
    shapes = staged(now.groupBy("band", "value", "root", "size", "common", "h1", "h2").agg(F.min(F.struct("fp", "parts")).alias("kg_one")).select("band", "value", "root", "size", "common", "kg_one.fp", "kg_one.parts"), "shapes")
    alike_there = between_classes(shapes).where(may(F.col("kg_size"), F.col("size")) & enough(F.least("common", "kg_common")) & enough(fewer)).select("kg_fp", "fp")
    rare = each.where((F.col("n") <= RARE) & (F.col("n") > 1)).select("fp", "size", "root", "shingle")
    shared = left(rare).join(rare, "shingle").where(apart).groupBy("kg_fp", "fp", "kg_size", "size").agg(F.count("*").alias("c"))
    common = counts.select("f", "common")
    shared = shared.join(common, F.col("fp") == F.col("f"), "left").drop("f").join(common.withColumnRenamed("common", "kg_common"), F.col("kg_fp") == F.col("f"), "left")
    shared = shared.where(enough(F.least(F.coalesce("common", F.lit(0)), F.coalesce("kg_common", F.lit(0))) + F.col("c"))).select("kg_fp", "fp")
    rest = alike_there.unionByName(shared).withColumnsRenamed({"kg_fp": "u", "fp": "v"})
    rest = staged(rest.select("u", "v").distinct(), "rest")
    return prints, _rooted(own, near.unionByName(confirmed(rest)))


def print_pairs(own: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets (fp) whose SimHashes (kg_print) the BK-trees link: sets of one SimHash with the smallest of them, and
    the smallest ones of SimHashes within the radius along a forest's edges, so fewer pairs than sets and edges."""
    heads = own.groupBy("kg_print").agg(F.min("fp").alias("head"))
    same = own.join(heads, "kg_print").where("fp <> head").select(F.col("head").alias("u"), F.col("fp").alias("v"))
    edges = links(heads.select(F.col("kg_print").alias("fp")))
    at = lambda x: heads.select(F.col("kg_print").alias(x), F.col("head").alias(f"kg_{x}"))
    return same.unionByName(edges.join(at("u"), "u").join(at("v"), "v").select(F.col("kg_u").alias("u"), F.col("kg_v").alias("v")))


_FACTS = ("fp", "size", "root", "common", "parts")


def between_classes(shapes: DataFrame) -> DataFrame:
    """Pairs of rows of one bucket (band, value) that are of different classes (root): the first with kg_ names, and the second.

    The bucket's largest class is never paired with itself, but all others meet it and one another. A smaller class's
    own pairs are no more than its pairs with the largest, so what is formed is at most twice what is returned, and a class of any size
    costs a bucket in proportion."""
    sizes = shapes.groupBy("band", "value", "root").agg(F.count("*").alias("n")).groupBy(F.col("band").alias("b"), F.col("value").alias("x")).agg(F.max(F.struct("n", "root")).alias("kg_main"))
    rest = shapes.join(sizes, (F.col("band") == F.col("b")) & (F.col("value") == F.col("x"))).where(F.col("root") != F.col("kg_main.root")).withColumn("kg_largest", F.col("kg_main.root")).drop("b", "x", "kg_main")
    met = rest.withColumnsRenamed({c: f"kg_{c}" for c in _FACTS}).join(shapes, ["band", "value"])
    return met.where((F.col("kg_root") != F.col("root")) & ((F.col("root") == F.col("kg_largest")) | (F.col("kg_fp") < F.col("fp"))))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    prints, of = classes(df, id_col, text_col)
    # A hot fingerprint is a hot key here; the join is of two exchanges, whose large partitions Spark splits.
    return prints.join(of, F.col("fingerprint") == F.col("kg_fp")).select(named(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float | None = None) -> DataFrame:
    """Of each class of near-duplicates the row of the smallest id (null last, then the smallest text hash), with all columns.

    With `least`, classes are those of 5-word shingles with a Jaccard index of `least` at least."""
    prints, of = classes(df, id_col, text_col) if least is None else alike(df, least, id_col, text_col)
    order = _order(id_col)
    # One row a fingerprint before classes meet, so a hot fingerprint is summed where it lies.
    first = prints.groupBy(F.col("fingerprint")).agg(F.min(order).alias("kg_first"))
    first = first.join(of, F.col("fingerprint") == F.col("kg_fp")).groupBy("kg_root").agg(F.min("kg_first").alias("f")).select(*_keys(F.col("f.b"), F.col("f.c")))
    # Keys without nulls, the same in the join and in dropping repeated rows: the texts are shuffled once.
    names = [f"kg_c{k}" for k in range(len(df.columns))]
    left = df.select(*_keys(named(id_col), F.xxhash64(named(text_col))), *(named(c).alias(n) for c, n in zip(df.columns, names, strict=True)))
    kept = left.join(first, list(_KEYS), "left_semi").dropDuplicates(list(_KEYS))
    return kept.select(*(F.col(n).alias(c) for c, n in zip(df.columns, names, strict=True)))


_KEYS = ("kg_none", "kg_id", "kg_key")


def _keys(id_: Column, key: Column) -> list[Column]:
    return [F.coalesce(x, F.lit(y)).alias(n) for x, y, n in zip((id_.isNull(), id_.cast("string"), key), (False, "", 0), _KEYS, strict=True)]
