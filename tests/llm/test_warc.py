import hashlib
import io

import pytest
from keelgrid.llm import warc
from keelgrid.llm.shared import filesystem
from pyspark.sql import functions as F


def test_reader_takes_members_one_by_one():
    bodies = [b"", b"x" * 200_000, bytes(range(256)) * 40]
    data = b"".join(warc.pack(warc.record(i, "http://a b/\r\nq", b, len(b), hashlib.sha1(b).hexdigest(), None)) for i, b in enumerate(bodies))
    for step in (7, 1 << 16):
        found = [warc.parse(h, b) for h, b in warc.records(io.BytesIO(data))]
        assert [f[6] for f in found] == bodies and [f[0] for f in found] == [0, 1, 2]
        assert found[0][1] == "http://a%20b/%0D%0Aq"
        assert b"".join(m for _, m in warc.members(io.BytesIO(data), step=step)).count(b"WARC/1.1") == 3


@pytest.mark.parametrize("harm", ["cut", "flip", "length", "digest"])
def test_harm_is_noticed(harm):
    body = b"hello " * 50
    raw = warc.record(1, "http://a/", body, len(body), hashlib.sha1(body).hexdigest(), None)
    if harm == "length":
        raw = raw.replace(b"\r\n\r\n", b"\r\n\r\n!", 2)
    if harm == "digest":
        raw = raw.replace(b"hello", b"hallo", 1)
    data = warc.pack(raw)
    if harm == "cut":
        data = data[:-9]
    if harm == "flip":
        data = data[:2] + b"\xff" + data[3:]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data)))


def test_pages(spark):
    big, other = "ä" * 600, "z" * 1000
    rows = [(1, "http://a/", big), (5, None, big), (3, "http://c/", big), (2, "http://d/", "x" * 999), (4, "http://e/", "x" * 999), (6, "http://f/", None), (7, "http://g/", ""), (8, "http://h/", other), (8, "http://h/", other), (9, "u", "<p>\x00</p>"), (None, "http://n/", big), (None, "v", "y" * 2000), (None, "v", "y" * 2000)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string")
    archives = warc.write_archives(df)
    got = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in warc.read_archives(archives).collect()), key=str)
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        same = [j for j, _, t in rows if (t or "") == (html or "") and j is not None]
        owner = max(same) if len(b) >= 1000 and same else None
        first = owner is None or owner == i
        want.append((i or -1, len(b), hashlib.sha1(b).hexdigest(), "response" if first else "revisit", -1 if first else owner))
    assert got == sorted(want, key=str)
    payloads = {r.page_id: r.payload for r in warc.read_archives(archives, with_payload=True).where("page_id is not null").collect()}
    assert payloads[5] == big.encode() and payloads[1] is None and payloads[6] == b""
    fs, path = filesystem(archives.first().archive)
    with fs.open_input_stream(path, compression=None) as f:
        assert f.read(2) == b"\x1f\x8b"


def test_empty_table(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []


def test_other_attempts_files_do_not_count(spark, tmp_path):
    rows = [(i, f"http://a/{i}", "x" * (i % 7 * 300)) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    lists = [warc.write_archives(x, f"file:{tmp_path}/w") for x in (df.repartition(3), df.orderBy(F.desc("page_id")).coalesce(2), df.repartition(5, "url"))]
    assert len({r.archive for x in lists for r in x.collect()}) == sum(x.count() for x in lists)
    for x in lists:
        assert sorted(r.page_id for r in warc.read_archives(x).collect()) == list(range(60))
    short = lists[0].withColumn("records", F.col("records") + 1)
    with pytest.raises(Exception, match="records instead of"):
        warc.read_archives(short).collect()


def test_very_long_page(spark):
    df = spark.createDataFrame([(1, "u", "long " * 2_000_000), (2, "u", "long " * 2_000_000)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc.read_archives(warc.write_archives(df)).collect()) == [(1, 10_000_000, "revisit"), (2, 10_000_000, "response")]
