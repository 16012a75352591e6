"""Shapefiles written byte by byte here come back ring for ring; geometry columns too."""

import codecs
import datetime
import struct

import numpy as np
import pytest
from keelgrid.sources import vector


def square(x, y, s):
    return [(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)]


SHAPES = [
    [square(0, 0, 10), square(2, 2, 3)[::-1], square(20, 20, 1)],  # a hole, a second part
    None,
    [square(-5.5, 3.25, 0.125)],
    [[(float(k), k * 0.5) for k in range(5000)] + [(0.0, 0.0)]],
]


def body(rings, kind):
    if rings is None:
        return struct.pack("<i", 0)
    points = [p for r in rings for p in r]
    xs, ys = zip(*points, strict=True)
    starts = np.cumsum([0, *map(len, rings)])[:-1]
    out = struct.pack("<i4d2i", kind, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
    return out + (bytes(16 + 8 * len(points)) if kind == 15 else b"")


def write_shapefile(base, shapes, rows, kind=5):
    shp, shx, at = b"", b"", 100
    for k, rings in enumerate(shapes, 1):
        record = body(rings, kind)
        shp += struct.pack(">2i", k, len(record) // 2) + record
        shx += struct.pack(">2i", at // 2, len(record) // 2)
        at += 8 + len(record)
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    base.with_suffix(".shp").write_bytes(head(100 + len(shp)) + shp)
    base.with_suffix(".shx").write_bytes(head(100 + len(shx)) + shx)
    fields = [("NAME", "C", 12, 0), ("CODE", "N", 6, 0), ("AREA", "N", 10, 3), ("OPEN", "L", 1, 0), ("DAY", "D", 8, 0)]
    width = 1 + sum(f[2] for f in fields)
    dbf = struct.pack("<4BIHH20x", 3, 99, 1, 1, len(rows), 32 + 32 * len(fields) + 1, width)
    dbf += b"".join(n.encode().ljust(11, b"\0") + k.encode() + bytes(4) + bytes([w, d]) + bytes(14) for n, k, w, d in fields) + b"\r"
    for row in rows:
        dbf += b" " + b"".join(str(v).encode().ljust(w)[:w] if k == "C" else str(v).encode().rjust(w)[:w] for v, (_, k, w, _) in zip(row, fields, strict=True))
    base.with_suffix(".dbf").write_bytes(dbf)


@pytest.mark.parametrize("kind, split", [(5, 1), (15, 3), (3, 10_000)])
def test_shapefile_comes_back(spark, tmp_path, kind, split):
    rows = [("Île", 7, "12.500", "T", "20240229"), ("", "", "", "?", ""), ("b", -3, "x", "n", "20249999"), ("c", 999999, "-0.125", "F", "19991231")]
    write_shapefile(tmp_path / "layer", SHAPES, rows, kind)
    df = vector.read_shapefile(spark, str(tmp_path / "layer.shp"), split)
    assert df.rdd.getNumPartitions() == -(-4 // split) and df.columns == ["NAME", "CODE", "AREA", "OPEN", "DAY", "rings"]
    got = df.collect()
    assert [None if r.rings is None else [[(p.x, p.y) for p in ring] for ring in r.rings] for r in got] == SHAPES
    assert [tuple(r[:5]) for r in got] == [("Île", 7, 12.5, True, datetime.date(2024, 2, 29)), (None,) * 5, ("b", -3, None, False, None), ("c", 999999, -0.125, False, datetime.date(1999, 12, 31))]


def test_empty_layer_and_small_chunks(spark, tmp_path, monkeypatch):
    write_shapefile(tmp_path / "none", [], [])
    assert vector.read_shapefile(spark, str(tmp_path / "none.shp")).collect() == []
    write_shapefile(tmp_path / "many", SHAPES * 5, [("n", k, 0, "T", "") for k in range(20)])
    monkeypatch.setattr(vector, "CHUNK", 300)
    reader = vector._ShapeReader(vector.Layer.of(str(tmp_path / "many")), None, 7)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) > 5 and [c for b in batches for c in b.column(1).to_pylist()] == list(range(20))
    assert [None if r is None else [[(p["x"], p["y"]) for p in ring] for ring in r] for b in batches for r in b.column(5).to_pylist()] == SHAPES * 5


def wkb(kind, body, order="<", flag=0):
    return struct.pack(f"{order}BI", int(order == "<"), kind | flag) + body


def points(rings, order="<", more=0):
    return struct.pack(f"{order}I", len(rings)) + b"".join(struct.pack(f"{order}I", len(r)) + b"".join(struct.pack(f"{order}{2 + more}d", *p, *[9.0] * more) for p in r) for r in rings)


def test_geometry_columns(spark):
    a, b = [square(0, 0, 4), square(1, 1, 1)], [square(9, 9, 2)]
    two = struct.pack("<I", 2) + wkb(3, points(a)) + wkb(3, points(b, ">"), ">")
    gp = b"GP\0" + bytes([0b00000011]) + struct.pack("<i", 4326) + bytes(32)
    rows = [
        (1, wkb(3, points(a)), a), (2, wkb(6, two), a + b), (3, gp + wkb(6, two), a + b), (4, wkb(3, points(a, more=1), flag=0x80000000), a), (5, wkb(1003, points(b, more=1)), b),
        (6, wkb(3, struct.pack("<I", 4326) + points(b), flag=0x20000000), b), (7, None, None), (8, wkb(3, struct.pack("<I", 0)), None), (9, wkb(7, struct.pack("<I", 1) + wkb(6, two)), a + b), (10, wkb(1, struct.pack("<2d", 1, 2)), [[(1, 2)]]),
    ]
    df = spark.createDataFrame([(i, g) for i, g, _ in rows], "`a.id` int, geometry binary")
    decoded = vector.decode_geometry(df, "geometry")
    again = vector.decode_geometry(vector.encode_geometry(decoded), "geometry")
    for found in (decoded, again):
        got = {r[0]: r[1] and [[(p.x, p.y) for p in ring] for ring in r[1]] for r in found.collect()}
        assert got == {i: want for i, _, want in rows}


@pytest.mark.parametrize("told, want", [("", "utf-8"), ("UTF-8", "utf-8"), ("ISO-8859-1", "iso8859-1"), ("1252", "cp1252"), ("ISO 88591", "latin-1")])
def test_encodings(told, want):
    assert codecs.lookup(vector._encoding(told)) == codecs.lookup(want)
