"""Rasters: what is written is read, tile by tile; files written byte by byte here; LZW of a known text."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from keelgrid.sources import raster


def test_lzw_of_known_bytes_and_of_all_kinds():
    # The worked example of the format's description: 7 7 7 8 8 7 7 6 6 gives 256 7 258 8 8 258 6 6 257 as 9-bit codes.
    text, codes = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]), [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    known = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert raster.pack_lzw(text) == known and raster.unpack_lzw(known, 9) == text
    rng = random.Random(1)
    for text in (b"", b"a", b"ab" * 40_000, bytes(rng.randrange(256) for _ in range(30_000)), bytes(rng.randrange(3) for _ in range(200_000)), bytes(5000)):
        assert raster.unpack_lzw(raster.pack_lzw(text), len(text)) == text
    for n in range(250, 270):  # where the codes' width changes at the end
        text = bytes(k * 7 % 256 for k in range(n))
        assert raster.unpack_lzw(raster.pack_lzw(text), n) == text


@pytest.mark.parametrize("compression, nodata", [("lzw", float("nan")), ("deflate", -9999.0), ("none", 0.5)])
def test_round_trip_of_sparse_cells(spark, tmp_path, compression, nodata):
    rng = random.Random(2)
    want = {(rng.randrange(300), rng.choice([rng.randrange(40), 200 + rng.randrange(117)])): float(np.float32(rng.gauss(0, 10))) for _ in range(3000)}
    rows = [(r, c, v) for (r, c), v in want.items()] + [(-1, 5, 1.0), (300, 0, 1.0), (5, 317, 1.0), (7, 7 if (7, 7) not in want else 160, None)]
    df = spark.createDataFrame(rows, "row long, col int, value double").repartition(5)
    path = str(tmp_path / "out.tif")
    for _ in range(2):  # also over a file that is there
        raster.write_raster(df, path, 317, 300, tile=32, compression=compression, nodata=nodata, frame=(-180.0, 90.0, 0.5, 0.25), epsg=4326)
    assert [p.name for p in tmp_path.iterdir()] == ["out.tif"]
    read = raster.read_raster(spark, path, split=3)
    got = {(r.row, r.col): r.value for r in read.collect()}
    assert got == want
    info = raster.Raster.of(path)
    assert (info.width, info.height, info.frame) == (317, 300, (-180.0, 90.0, 0.5, 0.25)) and (info.nodata == nodata or math.isnan(nodata) and math.isnan(info.nodata))
    assert (info.sizes == 0).any() and (info.sizes > 0).sum() == len({(r // 32, c // 32) for r, c in want})


def test_only_tiles_of_the_asked_rows_are_read(spark, tmp_path):
    df = spark.range(200 * 100).selectExpr("id div 100 AS row", "id % 100 AS col", "CAST(id AS DOUBLE) AS value")
    path = str(tmp_path / "a.tif")
    raster.write_raster(df, path, 100, 200, tile=16, compression="deflate")
    part = raster.read_raster(spark, path, (40, 47), (16, 20), split=1)
    assert part.rdd.getNumPartitions() == 1
    assert sorted(tuple(r) for r in part.collect()) == [(r, c, 100.0 * r + c) for r in range(40, 48) for c in range(16, 21)]
    reader = raster._FilteredReader(raster.Raster.of(path), 100, [0, 0], [1e9, 1e9])
    kept = list(reader.pushFilters([raster.GreaterThanOrEqual(("row",), 150), raster.LessThan(("col",), 10), raster.EqualTo(("value",), 3)]))
    assert len(kept) == 3 and sum(len(p.tiles) for p in reader.partitions()) == 4
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = raster.read_raster(spark, path, split=1).where("row >= 190 AND col = 3")
        assert pushed.rdd.getNumPartitions() == 2 and pushed.count() == 10
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    points = spark.createDataFrame([(41, 17), (41, 17), (60, 99), (500, 3), (None, 3)], "row long, col long")
    assert sorted(map(tuple, raster.sample_raster(points, path).collect()), key=str) == sorted([(41, 17, 4117.0), (41, 17, 4117.0), (60, 99, 6099.0), (500, 3, None), (None, 3, None)], key=str)
    assert raster.sample_raster(points.limit(0), path).collect() == []


def test_no_cells(spark, tmp_path):
    path = str(tmp_path / "none.tif")
    raster.write_raster(spark.createDataFrame([], "row long, col long, value double"), path, 50, 60)
    assert raster.read_raster(spark, path).collect() == [] and raster.Raster.of(path).height == 60


def tiff(values, order, kind, bits, strip_rows, pack=bytes, compression=1, predictor=1, big=False):
    """A file in strips, with the directory after the data."""
    rows, width = values.shape
    strips = [pack(values[k : k + strip_rows].tobytes()) for k in range(0, rows, strip_rows)]
    start = 16 if big else 8
    at = start + sum(map(len, strips))
    offsets = [start + sum(map(len, strips[:k])) for k in range(len(strips))]
    number, long_ = ("Q", 16) if big else ("I", 4)
    tags = [(256, 4, [width]), (257, 4, [rows]), (258, 3, [bits]), (259, 3, [compression]), (273, long_, offsets), (278, 4, [strip_rows]), (279, long_, list(map(len, strips))), (317, 3, [predictor]), (339, 3, [kind])]
    inline, entries, extra = (8, b"", b"") if big else (4, b"", b"")
    after = at + (8 if big else 2) + len(tags) * (20 if big else 12) + inline
    for tag, type_, v in tags:
        data = struct.pack(order + str(len(v)) + {3: "H", 4: "I", 16: "Q"}[type_], *v)
        if len(data) > inline:
            data, extra = struct.pack(order + number, after + len(extra)), extra + data
        entries += struct.pack(order + "HH" + number, tag, type_, len(v)) + data.ljust(inline, b"\0")
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return head + b"".join(strips) + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + bytes(inline) + extra


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("case", ["f4", "f8", "u1", "i2 difference", "f4 bytes apart", "u4 big"])
def test_files_of_other_writers(spark, tmp_path, order, case):
    kind = case.split()[0]
    values = (np.arange(35).reshape(7, 5) * 3 % 50).astype(order + kind)
    raw, predictor, pack, compression = values, 1, bytes, 1
    if "difference" in case:
        raw, predictor, pack, compression = np.diff(values, axis=1, prepend=values.dtype.type(0)).astype(values.dtype), 2, raster.pack_lzw, 5
    if "apart" in case:
        planes = values.astype(">f4").view(np.uint8).reshape(7, 5, 4).transpose(0, 2, 1).reshape(7, 20)
        raw, predictor, pack, compression = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8), 3, zlib.compress, 8
    data = tiff(raw, order, {"u": 1, "i": 2, "f": 3}[kind[0]], int(kind[1]) * 8, 3, pack, compression, predictor, "big" in case)
    if "apart" in case:  # the width is in cells, not bytes
        data = data.replace(struct.pack(order + "HHII", 256, 4, 1, 20), struct.pack(order + "HHII", 256, 4, 1, 5))
    (tmp_path / "x.tif").write_bytes(data)
    got = {(r.row, r.col): r.value for r in raster.read_raster(spark, str(tmp_path / "x.tif")).collect()}
    assert got == {(r, c): float(values[r, c]) for r in range(7) for c in range(5)}
