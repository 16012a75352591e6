"""Vector layers: shapefiles as a splittable Spark source, and geometry columns (WKB, with GeoPackage's header or without).

A geometry is an array of rings (or of parts of a line, or one part of one point); a ring is an array of (x, y), as it
stands in the file, its first point repeated at the end. Holes and further polygons of one shape are further rings: the even-odd
rule needs no more. Empty and null shapes are null. Heights and measures are passed over.
"""

from __future__ import annotations

import codecs
import datetime
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from keelgrid.sources.files import exists, file_size, read_range

RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
#: Records of a split, and bytes read at once.
SPLIT, CHUNK = 10_000, 16 << 20
#: Numbers of the formats (fixed values): shapes with parts, points, many points, each also with heights or measures.
_PARTS, _POINT, _POINTS = (3, 5, 13, 15, 23, 25), (1, 11, 21), (8, 18, 28)


def rings_array(shapes: list[list[np.ndarray] | None]) -> pa.Array:
    """Arrow's nested lists from lists of (n, 2) arrays."""
    rings = [r for s in shapes for r in s or ()]
    points = np.concatenate(rings) if rings else np.zeros((0, 2))
    flat = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], names=["x", "y"])
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rings)]), pa.int32()), flat)
    outer = pa.array(np.cumsum([0, *(len(s or ()) for s in shapes)]), pa.int32())
    return pa.ListArray.from_arrays(outer, inner, mask=pa.array([s is None for s in shapes]))


def shape_rings(record: bytes) -> list[np.ndarray] | None:
    """The parts of one record of a shapefile, without its header."""
    kind = struct.unpack_from("<i", record)[0]
    if kind in _POINT:
        return [np.frombuffer(record, "<f8", 2, 4).reshape(1, 2)]
    if kind in _POINTS:
        return [np.frombuffer(record, "<f8", 2 * struct.unpack_from("<i", record, 36)[0], 40).reshape(-1, 2)]
    if kind not in _PARTS:
        return None
    parts, points = struct.unpack_from("<2i", record, 36)
    starts = np.frombuffer(record, "<i4", parts, 44)
    xy = np.frombuffer(record, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    return np.split(xy, starts[1:]) if points else None


@dataclass
class Field:
    name: str
    kind: str
    at: int
    width: int
    decimals: int

    def type(self) -> T.DataType:
        if self.kind in "NF":
            return T.LongType() if not self.decimals and self.width <= 18 and self.kind == "N" else T.DoubleType()
        return {"L": T.BooleanType(), "D": T.DateType()}.get(self.kind, T.StringType())

    def value(self, raw: bytes, encoding: str):
        """Null for what is empty or cannot be read."""
        text = raw.decode(encoding, "replace").strip().strip("\0")
        if not text:
            return None
        try:
            kind = self.type()
            if isinstance(kind, T.LongType):
                return int(float(text)) if "." in text else int(text)
            if isinstance(kind, T.DoubleType):
                return float(text)
            if isinstance(kind, T.DateType):
                return datetime.datetime.strptime(text, "%Y%m%d").date()
        except ValueError:
            return None
        return {"t": True, "y": True, "f": False, "n": False}.get(text.lower()) if self.kind == "L" else text


@dataclass
class Layer:
    """What the index and the table's header say: where things are, not what they hold."""

    base: str
    records: int
    fields: list[Field]
    head: int
    row: int
    encoding: str

    @classmethod
    def of(cls, path: str) -> Layer:
        base = path[:-4] if path.lower().endswith(".shp") else path
        records, fields, head, row = (file_size(f"{base}.shx") - 100) // 8, [], 0, 0
        if exists(f"{base}.dbf"):
            head, row = struct.unpack_from("<2H", read_range(f"{base}.dbf", 0, 32), 8)
            raw, at = read_range(f"{base}.dbf", 32, head - 32), 1
            for k in range(0, len(raw) - 31, 32):
                if raw[k] == 0x0D:
                    break
                name, kind, width, decimals = raw[k : k + 11].split(b"\0")[0].decode("ascii", "replace"), chr(raw[k + 11]), raw[k + 16], raw[k + 17]
                fields.append(Field(name, kind, at, width, decimals))
                at += width
        told = read_range(f"{base}.cpg", 0, 64).decode("ascii", "replace").strip() if exists(f"{base}.cpg") else ""
        return cls(base, records, fields, head, row, _encoding(told))


def _encoding(told: str) -> str:
    """What a .cpg file names: UTF-8 where there is none, Latin-1 where Python does not know the name."""
    try:
        return codecs.lookup(told or "utf-8").name
    except LookupError:
        return "latin-1"


class Shapefile(DataSource):
    """spark.read.format("keelgrid_shapefile").load(path of .shp): the table's columns and `rings`, one row a shape.

    The index (.shx) tells where each record lies, so splits are ranges of records (option `split`, how many) and a task
    reads only its bytes of the three files, CHUNK at a time."""

    @classmethod
    def name(cls) -> str:
        return "keelgrid_shapefile"

    def schema(self) -> T.StructType:
        layer = Layer.of(self.options["path"])
        return T.StructType([*(T.StructField(f.name, f.type()) for f in layer.fields), T.StructField("rings", RINGS)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ShapeReader(Layer.of(self.options["path"]), schema, int(self.options.get("split", SPLIT)))


@dataclass
class _Range(InputPartition):
    first: int
    last: int


class _ShapeReader(DataSourceReader):
    def __init__(self, layer: Layer, schema: T.StructType, split: int):
        self.layer, self.schema, self.split = layer, schema, split

    def partitions(self) -> list[_Range]:
        n = self.layer.records
        return [_Range(a, min(a + self.split, n)) for a in range(0, max(1, n), self.split)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        layer = self.layer
        index = np.frombuffer(read_range(f"{layer.base}.shx", 100 + 8 * part.first, 8 * (part.last - part.first)), ">i4").reshape(-1, 2).astype(np.int64) * 2
        at = 0
        while at < len(index):
            # As many records as CHUNK holds, one at least; records need not lie in order.
            end = at + max(1, int(np.searchsorted(np.cumsum(index[at:, 1] + 8), CHUNK, "right")))
            low, high = int(index[at:end, 0].min()), int((index[at:end, 0] + index[at:end, 1] + 8).max())
            if high - low > 2 * CHUNK + int(index[at:end, 1].sum()):
                end, low, high = at + 1, int(index[at, 0]), int(index[at].sum()) + 8
            raw = read_range(f"{layer.base}.shp", low, high - low)
            shapes = [shape_rings(raw[o - low + 8 : o - low + 8 + size]) for o, size in index[at:end].tolist()]
            table = read_range(f"{layer.base}.dbf", layer.head + layer.row * (part.first + at), layer.row * (end - at)) if layer.fields else b""
            columns = []
            for f in layer.fields:
                values = [f.value(table[k * layer.row + f.at : k * layer.row + f.at + f.width], layer.encoding) for k in range(end - at)]
                columns.append(pa.array(values, {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(), T.DateType: pa.date32()}.get(type(f.type()), pa.string())))
            yield pa.RecordBatch.from_arrays([*columns, rings_array(shapes)], names=[*(f.name for f in layer.fields), "rings"])
            at = end


def read_shapefile(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(Shapefile)
    return spark.read.format("keelgrid_shapefile").option("split", split).load(path)


def wkb_rings(raw: bytes) -> list[np.ndarray] | None:
    """Rings of well-known binary, points and lines too; a GeoPackage header in front is passed over."""
    at = 0
    if raw[:2] == b"GP":
        at = 8 + (0, 32, 48, 48, 64)[raw[3] >> 1 & 7]
    rings: list[np.ndarray] = []

    def points(order: str, size: int, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, f"{order}f8", size * n, at).reshape(n, size)[:, :2].astype(float)
        at += 8 * size * n
        return out

    def number(order: str) -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(f"{order}I", raw, at - 4)[0]

    left = 1
    while left:  # geometries still to come; collections add theirs
        order, at, left = "<" if raw[at] else ">", at + 1, left - 1
        code = number(order)
        if code & 0x20000000:
            number(order)  # a reference system
        flags, kind = (code & 0x0FFFFFFF) // 1000, (code & 0x0FFFFFFF) % 1000
        size = 2 + (bool(code & 0x80000000) or flags in (1, 3)) + (bool(code & 0x40000000) or flags in (2, 3))
        if kind == 1:
            rings += [p for p in [points(order, size, 1)] if not np.isnan(p).all()]
        elif kind == 2:
            rings.append(points(order, size, number(order)))
        elif kind == 3:
            rings += [points(order, size, number(order)) for _ in range(number(order))]
        elif kind in (4, 5, 6, 7):
            left += number(order)
        else:
            raise ValueError(f"geometry type {kind} is not read")
    return [r for r in rings if len(r)] or None


def ring_wkb(rings: list | None) -> bytes | None:
    """One polygon of these rings, little-endian."""
    if not rings:
        return None
    parts = [np.array([(p["x"], p["y"]) for p in r], "<f8") for r in rings]
    return struct.pack("<BII", 1, 3, len(parts)) + b"".join(struct.pack("<I", len(r)) + r.tobytes() for r in parts)


def decode_geometry(df: DataFrame, column: str, out: str = "rings") -> DataFrame:
    """Replaces a column of WKB, GeoPackage's or plain, by its rings; null where it is null or holds nothing."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield rings_array([wkb_rings(x) if x else None for x in batch.to_pylist()])

    return _replaced(df, column, F.arrow_udf(run, RINGS), out)


def encode_geometry(df: DataFrame, column: str = "rings", out: str = "geometry") -> DataFrame:
    """The opposite: rings as the WKB of one polygon."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([ring_wkb(x) for x in batch.to_pylist()], pa.binary())

    return _replaced(df, column, F.arrow_udf(run, T.BinaryType()), out)


def _replaced(df: DataFrame, column: str, function, out: str) -> DataFrame:
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*(name(c) for c in df.columns if c != column), function(name(column)).alias(out))
