"""Content-addressed store of token ids.

A document's id stream (with an end id) is cut into chunks where a rolling hash over the last 16 ids has MASK zero bits,
at least MIN_IDS and at most MAX_IDS ids apart. A chunk is named by the BLAKE2b digest of its ids and stored once: of all places that
have it, the first container in order keeps it. A folder has:

  containers/   files of chunks one after another, each packed by zstd
  chunks/       digest, container, offset, size, ids: where each chunk lies
  recipes/      doc_id, start, n_tokens, digests, and the leaf hash, in ascending doc_id from file to file
  manifest/     the Merkle tree: level 0 has a node for each block of recipes, level 3 the root

`start` counts the ids of all documents before. Ids up to 65535 take two bytes, larger ones four. Reading
takes each chunk from its container, verifies its digest, and checks every document against its leaf, the leaves
against the blocks, the blocks against the root.

Null and empty texts are the end id alone. doc_id is an integer; null comes before all; rows of one id are ordered by the
hash of their ids. Other columns are left out. An empty table gives an empty store. Blocks of recipes are ranges of ids
of about WIDTH rows whatever the ids are, and are numbered in order (with_blocks), so the tree goes by rank.

Texts are encoded where they lie, once; ids never pass a shuffle. Only digests and places do: of a chunk that a third of
all documents have, one partial minimum a task. Each attempt of a task writes containers of its own; the written tables,
which hold one attempt of each task, say which count.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelgrid.llm.shared import attempt, block_of, discard, filesystem, portions, put, running_starts, shared_folder, with_blocks
from keelgrid.llm.tokens import encoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
MASK, MIN_IDS, MAX_IDS, ROLL, CONTAINER_BYTES, WIDTH = 8, 64, 2048, 16, 16_000_000, 256
#: Bytes between two wanted chunks of a container that are read along rather than skipped.
GAP = 1 << 16
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 63, 1 << 17, dtype=np.uint64)


def cuts(ids: np.ndarray, sizes: np.ndarray, mask: int = MASK, least: int = MIN_IDS, most: int = MAX_IDS) -> list[list[int]]:
    """For id streams that stand one after another: the ends of each one's chunks. The rolling hash knows nothing of the
    stream before."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if not len(ids):
        return [[] for _ in sizes]
    h = _GEAR[ids & np.uint32(0xFFFF)]
    since = np.arange(len(ids)) - np.repeat(starts, sizes)
    span = 1
    while span < ROLL:  # sums over the last 2 * span ids from sums over span
        h[span:] += np.where(since[span:] >= span, h[:-span] << np.uint64(span), np.uint64(0))
        span *= 2
    hits = np.flatnonzero((h >> np.uint64(40)) & np.uint64((1 << mask) - 1) == 0) + 1
    out = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        at, own = a, []
        for x in hits[np.searchsorted(hits, a, "right") : np.searchsorted(hits, b, "left")].tolist():
            while x - at > most:
                at += most
                own.append(at - a)
            if x - at >= least:
                at = x
                own.append(at - a)
        while b - at > most:
            at += most
            own.append(at - a)
        if b > at:
            own.append(b - a)
        out.append(own)
    return out


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def leaf_hash(doc_id: int | None, start: int, n: int, digests: list[bytes]) -> bytes:
    return hashlib.sha256(f"{'' if doc_id is None else doc_id} {start} {n} ".encode() + b"".join(digests)).digest()


def _leaf() -> Column:
    head = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.col("start").cast("string"), F.lit(" "), F.col("n_tokens").cast("string"), F.lit(" "))
    return F.unhex(F.sha2(F.concat(F.encode(head, "utf-8"), F.unhex(F.array_join(F.transform("digests", lambda d: F.hex(d)), ""))), 256))


def _small(raw: bytes) -> bytes:
    """Ids for a container: a mark, then two bytes an id, low bytes first, or four."""
    ids = np.frombuffer(raw, "<u4")
    if len(ids) and ids.max() > 0xFFFF:
        return b"\4" + raw
    return b"\2" + ids.astype("<u2").tobytes()


def _large(data: bytes) -> bytes:
    return data[1:] if data[:1] == b"\4" else np.frombuffer(data[1:], "<u2").astype("<u4").tobytes()


class TokenStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    # Writing

    @classmethod
    def write(cls, df: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = 2) -> "TokenStore":
        spark = df.sparkSession
        store = cls(spark, folder or shared_folder(spark, "tokens"))
        fs, path = filesystem(store.folder)
        for name in ("raw", "containers"):
            fs.create_dir(f"{path}/{name}", recursive=True)
        df = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        df.mapInArrow(_encode(store.folder, vocabulary, end_id), "doc_id long, n_tokens long, digests array<binary>, first binary, new array<struct<digest:binary,container:string,offset:long,size:int,ids:int>>").write.parquet(f"{store.folder}/encoded")
        encoded = store.table("encoded")
        store._keep_one(encoded)
        store._recipes(encoded)
        store._manifest()
        for name in ("raw", "encoded"):
            discard(spark, f"{store.folder}/{name}")
        return store

    def _keep_one(self, encoded: DataFrame) -> None:
        """Copies each container without the chunks that an earlier container has."""
        places = encoded.select(F.explode("new").alias("c")).select("c.*")
        first = places.groupBy("digest").agg(F.min(F.struct("container", "offset", "size", "ids")).alias("p"))
        live = first.select("p.container", F.struct("p.offset", "p.size", "p.ids", "digest").alias("c")).groupBy("container").agg(F.sort_array(F.collect_list("c")).alias("live"))
        live.repartition("container").mapInArrow(_compact(self.folder), "digest binary, container string, offset long, size int, ids int").write.parquet(f"{self.folder}/chunks")

    def _recipes(self, encoded: DataFrame) -> None:
        rows = with_blocks(encoded.select("doc_id", "n_tokens", "digests", "first"), "doc_id", F.conv(F.substring(F.hex("first"), 1, 3), 16, 10).cast("int"), "block", WIDTH)
        counts = running_starts(rows.groupBy("block").agg(F.sum("n_tokens").alias("size")), "block", "size").select(F.col("block").alias("b"), "base")
        inside = Window.partitionBy("block").orderBy(F.asc_nulls_first("doc_id"), "first", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        rows = rows.join(counts, F.col("block") == F.col("b")).select("block", "doc_id", (F.col("base") + F.col("before")).cast("long").alias("start"), "n_tokens", "digests")
        rows.repartitionByRange("block").sortWithinPartitions("block", "start").withColumn("leaf", _leaf()).write.parquet(f"{self.folder}/recipes")

    def _manifest(self) -> None:
        level(self.table("recipes").select(F.col("block"), "start", "leaf")).write.parquet(f"{self.folder}/manifest")

    # Reading

    def verify(self) -> None:
        """Builds the Merkle tree anew from the recipes and compares every node with the manifest."""
        again = level(self.table("recipes").select("block", "start", _leaf().alias("leaf")))
        kept = self.table("manifest")
        other = again.select(F.col("level").alias("l"), F.col("node").alias("n"), F.col("hash").alias("h"))
        wrong = kept.join(other, (F.col("level") == F.col("l")) & F.col("node").eqNullSafe(F.col("n")), "full").where(~F.col("hash").eqNullSafe(F.col("h")))
        if bad := wrong.select("level", "node", "l", "n").take(3):
            raise ValueError(f"the Merkle manifest does not fit the recipes: {bad}")

    def documents(self, with_ids: bool = True) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 and with_ids the ids (little-endian unsigned 32-bit) of every document, each
        put together from its chunks and verified."""
        self.verify()
        chunks = self.table("chunks").select(F.col("digest").alias("d"), F.struct("container", "offset", "size").alias("place"))
        parts = self.table("recipes").select("block", "start", F.posexplode("digests").alias("seq", "digest"))
        found = parts.join(chunks, F.col("digest") == F.col("d"), "left").groupBy("block", "start").agg(F.sort_array(F.collect_list(F.struct("seq", "place"))).alias("parts"))
        recipes = self.table("recipes").select(F.col("block").alias("b"), F.col("start").alias("s"), "doc_id", "n_tokens", "digests")
        whole = found.join(recipes, (F.col("block") == F.col("b")) & (F.col("start") == F.col("s"))).select("block", "doc_id", "start", "n_tokens", "digests", F.col("parts.place").alias("places"))
        schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
        return whole.repartition("block").sortWithinPartitions("block", "start").mapInArrow(_assemble(self.folder, with_ids), schema)


def level(leaves: DataFrame) -> DataFrame:
    """Merkle nodes (level, node, hash) over leaves (block, start, leaf): a node hashes what lies under it in order. A
    block has at most WIDTH different ids under it, each higher node at most 1024 nodes; the root has the rest."""
    hashed = lambda x: F.unhex(F.sha2(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(x)), lambda y: F.hex(y["hash"])), "")), 256))
    now = leaves.groupBy(F.col("block").alias("node")).agg(hashed(F.struct("start", F.col("leaf").alias("hash"))).alias("hash"))
    out = now.select(F.lit(0).alias("level"), "node", "hash")
    for k in (1, 2):
        now = now.groupBy(block_of("node", 1024).alias("up")).agg(hashed(F.struct("node", "hash")).alias("hash")).select(F.col("up").alias("node"), "hash")
        out = out.unionByName(now.select(F.lit(k).alias("level"), "node", "hash"))
    root = now.groupBy().agg(hashed(F.struct("node", "hash")).alias("hash"))
    return out.unionByName(root.select(F.lit(3).alias("level"), F.lit(0).cast("long").alias("node"), "hash"))


def _encode(folder: str, vocabulary: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        who, number, held, size = attempt(), 0, [], 0
        packer, seen = zstandard.ZstdCompressor(level=1), set()
        name = lambda: f"{who}-{number:04d}.ids"
        for batch, texts in portions(batches, "text", 4_000_000):
            raws = [x + end for x in encoder(vocabulary).encode(texts)]
            ids = np.frombuffer(b"".join(raws), "<u4")
            lists, news = [], []
            for raw, ends in zip(raws, cuts(ids, np.array([len(x) // 4 for x in raws])), strict=True):
                own, new = [], []
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    piece = raw[4 * a : 4 * b]
                    own.append(d := digest(piece))
                    if d not in seen:
                        seen.add(d)
                        packed = packer.compress(_small(piece))
                        new.append({"digest": d, "container": name(), "offset": size, "size": len(packed), "ids": b - a})
                        held.append(packed)
                        size += len(packed)
                        if size >= CONTAINER_BYTES:
                            put(fs, f"{path}/raw/{name()}", b"".join(held))
                            number, held, size = number + 1, [], 0
                lists.append(own)
                news.append(new)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in raws]),
                    pa.array(lists, pa.list_(pa.binary())),
                    pa.array([digest(b"".join(x)) for x in lists], pa.binary()),
                    pa.array(news, pa.list_(pa.struct([("digest", pa.binary()), ("container", pa.string()), ("offset", pa.int64()), ("size", pa.int32()), ("ids", pa.int32())]))),
                ],
                names=["doc_id", "n_tokens", "digests", "first", "new"],
            )
        if held:
            put(fs, f"{path}/raw/{name()}", b"".join(held))

    return run


def _compact(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            for container, live in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{path}/raw/{container}", compression=None) as f:
                    data = f.read()
                pieces, at, offsets = [], 0, []
                for c in live:
                    offsets.append(at)
                    pieces.append(data[c["offset"] : c["offset"] + c["size"]])
                    at += c["size"]
                where = f"{container.partition('.')[0]}.{attempt()}.ids"
                put(fs, f"{path}/containers/{where}", b"".join(pieces))
                yield pa.RecordBatch.from_arrays([pa.array([c["digest"] for c in live], pa.binary()), pa.array([where] * len(live)), pa.array(offsets, pa.int64()), pa.array([c["size"] for c in live], pa.int32()), pa.array([c["ids"] for c in live], pa.int32())], names=["digest", "container", "offset", "size", "ids"])

    return run


def _chunks(fs, path: str, places: set[tuple[str, int, int]]) -> dict[tuple[str, int], bytes]:
    """The packed chunks by container and offset. What lies near each other in a container is read at once."""
    out = {}
    wanted = sorted(places)
    at = 0
    while at < len(wanted):
        name = wanted[at][0]
        with fs.open_input_file(f"{path}/containers/{name}") as f:
            while at < len(wanted) and wanted[at][0] == name:
                first, end, upto = wanted[at][1], wanted[at][1], at
                while upto < len(wanted) and wanted[upto][0] == name and wanted[upto][1] - end <= GAP:
                    end = wanted[upto][1] + wanted[upto][2]
                    upto += 1
                data = f.read_at(end - first, first)
                for _, offset, size in wanted[at:upto]:
                    out[name, offset] = data[offset - first : offset - first + size]
                at = upto
    return out


def _assemble(folder: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, path), unpack = filesystem(folder), zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = list(zip(*(part.column(k).to_pylist() for k in ("doc_id", "n_tokens", "digests", "places")), strict=True))
                if bad := [r[0] for r in rows if None in r[3]]:
                    raise ValueError(f"document {bad[0]}: a chunk is missing or does not fit its digest")
                packed = _chunks(fs, path, {(p["container"], p["offset"], p["size"]) for r in rows for p in r[3]})
                ids, known = [], {}
                for doc, n, digests, places in rows:
                    pieces = []
                    for d, place in zip(digests, places, strict=True):
                        if d not in known:
                            piece = _large(unpack.decompress(packed[place["container"], place["offset"]], max_output_size=8 * MAX_IDS))
                            if digest(piece) != d:
                                raise ValueError(f"document {doc}: a chunk is missing or does not fit its digest")
                            known[d] = piece
                        pieces.append(known[d])
                    ids.append(b"".join(pieces))
                    if len(ids[-1]) != 4 * n:
                        raise ValueError(f"document {doc}: {len(ids[-1]) // 4} ids instead of {n}")
                columns = [part.column("doc_id"), part.column("start"), part.column("n_tokens"), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return run
