"""WARC archives: a writer that replaces equal payloads by revisit records, and a sequential reader.

Every record is one gzip member. The reader goes through an archive from front to end, unpacks it step by step, takes
each block by its Content-Length and verifies the block digest, for responses the payload digest too; what does not fit
is an error that names the archive and the place. Nothing larger than a record is held.

Payloads are the html in UTF-8 (null: empty). Of records with equal payloads of MIN_REVISIT bytes at least, the one with
the largest page_id is a response and the others are revisits of it; rows that repeat that page_id are responses too,
and so are all records if no page of the group has an id. A null page_id comes back as null. Control characters in a url
are percent-encoded. Other columns are not written. An empty table makes no archive and gives no rows.

Payloads are grouped by digest with partial aggregates; only digests that occur twice are joined back, in a sort-merge join
whose large partitions Spark splits. Archives lie in a shared folder. Each attempt of a task names its own files, and the written
list of archives, which holds one attempt of each task, alone says which count; the reader compares the records of an
archive with that list, so a lost, doubled or changed file is an error and not a wrong result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelgrid.llm.shared import attempt, filesystem, put, shared_folder, staged

MIN_REVISIT, ARCHIVE_BYTES, STEP = 1000, 32_000_000, 1 << 16
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record, not yet packed. For a revisit the payload is empty; size and digest are the full payload's."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    head += [("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def pack(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream: BinaryIO, name: str = "archive", step: int = STEP) -> Iterator[tuple[int, bytes]]:
    """Place and content of each gzip member. A content is gathered from pieces that were unpacked a step at a time."""
    place, rest = 0, b""
    while True:
        rest = rest or stream.read(step)
        if not rest:
            return
        z, content, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not rest and not (rest := stream.read(step)):
                raise ValueError(f"{name}: the member at byte {place} is cut off")
            before = len(rest)
            try:
                content.append(z.decompress(rest, 16 * step))
            except zlib.error as e:
                raise ValueError(f"{name}: the member at byte {place} can't be unpacked: {e}") from e
            rest = z.unused_data if z.eof else z.unconsumed_tail
            used += before - len(rest)
        yield place, b"".join(content)
        place += used


def records(stream: BinaryIO, name: str = "archive") -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, framed by Content-Length and verified by digest."""
    for place, data in members(stream, name):
        end = data.find(b"\r\n\r\n")
        lines = data[:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"{name}: no record begins at byte {place}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size :] != b"\r\n\r\n":
            raise ValueError(f"{name}: the record at byte {place} is not as long as its Content-Length says")
        if head.get("warc-block-digest", _digest(block)) != _digest(block):
            raise ValueError(f"{name}: the block at byte {place} does not fit its digest")
        yield head, block


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parse(head: dict[str, str], block: bytes, name: str = "archive") -> tuple[int | None, str | None, str, int, str, int | None, bytes | None]:
    """page_id, url, type, size and digest of the full payload, refers_to, and the payload (None for revisits)."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)^content-length: *(\d+)", http, re.M)[1])
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{name}: the payload of {head['warc-record-id']} does not fit its digest or length")
    return _number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], size, digest, _number(head.get("warc-refers-to")), payload if head["warc-type"] == "response" else None


def write_archives(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """Writes the archives and returns the written list of them: archive, records, bytes."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark, "warc")
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    html = F.coalesce(F.col(html_col), F.lit(""))
    pages = df.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha1(html.cast("binary")).alias("digest"))
    twice = pages.where(F.col("size") >= least).groupBy("digest").agg(F.max("page").alias("owner"), F.count("*").alias("n")).where("n > 1 and owner is not null").select(F.col("digest").alias("d"), "owner")
    told = pages.join(twice, F.col("digest") == F.col("d"), "left")
    refers = F.when(F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page")), F.col("owner"))
    told = told.select("page", "url", "size", "digest", refers.alias("refers"), F.when(refers.isNull(), F.col("html")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        own, made = attempt(), []
        held, size, n = [], 0, 0

        def close() -> None:
            nonlocal held, size, n
            name = f"part-{own}-{len(made):04d}.warc.gz"
            put(fs, f"{path}/{name}", b"".join(held))
            made.append((f"{folder}/{name}", n, size))
            held, size, n = [], 0, 0

        for batch in batches:
            for page, url, length, digest, refers, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(pack(record(page, url, (html or "").encode(), length, digest, refers)))
                size, n = size + len(held[-1]), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["archive", "records", "bytes"])

    return staged(told.mapInArrow(run, "archive string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Rows of the records of the listed archives (archive, records), one task or more an archive at a time."""
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())][: 7 if with_payload else 6]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = filesystem(name)
                found, held, n = [], 0, 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for head, block in records(stream, name):
                        found.append(parse(head, block, name))
                        n += 1
                        held += len(block) if with_payload else 100
                        if held >= 1_000_000:
                            yield rows(found)
                            found, held = [], 0
                if n != told:
                    raise ValueError(f"{name}: {n} records instead of {told}")
                yield rows(found)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload
    count = max(1, min(archives.count(), 20_000))
    return archives.select("archive", "records").repartition(count).mapInArrow(run, schema)
