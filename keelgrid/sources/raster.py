"""GeoTIFF rasters of one band as a Spark source that reads only the tiles it needs, and as a writer of one file from sparse cells.

Cells are (row, col, value), row 0 the northernmost. Cells without data are not given, and need not be given to the writer;
tiles without cells take no bytes. Coordinates of a cell come from the file's tie point and pixel size (`frame`).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from keelgrid.sources.files import filesystem, read_range

CELLS = T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType()), T.StructField("value", T.DoubleType())])
#: Tiles of a split, rows and columns of a written tile, bytes copied at once.
SPLIT, TILE, COPY = 16, 256, 8 << 20
#: Numbers of the format (fixed values): sizes of field types; tags; compressions.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, PIXEL, TIE, GEO_KEYS, NODATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
NONE, LZW, DEFLATE = 1, 5, 8


def unpack_lzw(raw: bytes, size: int) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the highest bit first, one step early; 256 clears the table, 257 ends."""
    out, table, width, bits, have, before = bytearray(), [], 9, 0, 0, None
    for byte in raw:
        bits, have = (bits << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have & (1 << width) - 1
        if code == 256:
            table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        if code == 257 or len(out) >= size:
            break
        if before is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            table.append(before + entry[:1])
            if len(table) in (511, 1023, 2047):
                width += 1
        out += entry
        before = entry
    return bytes(out[:size])


def pack_lzw(raw: bytes) -> bytes:
    """The opposite; the table is cleared when it is full."""
    clear = {bytes([k]): k for k in range(256)}
    table, width, out, bits, have = dict(clear), 9, bytearray(), 256, 9

    def flush() -> None:
        nonlocal bits, have
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
        bits &= (1 << have) - 1

    run, added = b"", 258
    for at in range(len(raw)):
        longer = run + raw[at : at + 1]
        if longer in table:
            run = longer
            continue
        bits, have = bits << width | table[run], have + width
        table[longer], added = added, added + 1
        run = raw[at : at + 1]
        if added in (512, 1024, 2048):
            width += 1
        if added == 4095:
            bits, have = bits << width | 256, have + width
            table, width, added = dict(clear), 9, 258
        flush()
    if run:
        bits, have = bits << width | table[run], have + width
        if added + 1 in (512, 1024, 2048):
            width += 1
    bits, have = bits << width | 257, have + width
    bits, have = bits << (-have % 8), have + -have % 8
    flush()
    return bytes(out)


def pack(raw: bytes, compression: int) -> bytes:
    return {NONE: bytes, LZW: pack_lzw, DEFLATE: zlib.compress}[compression](raw)


@dataclass
class Raster:
    """A file's directory: how large it is, where its tiles (or strips) lie, what a cell is."""

    path: str
    width: int
    height: int
    tile_width: int
    tile_height: int
    offsets: np.ndarray
    sizes: np.ndarray
    dtype: np.dtype
    compression: int
    predictor: int
    nodata: float | None
    frame: tuple[float, float, float, float] | None = None  # west, north, width and height of a cell

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @classmethod
    def of(cls, path: str) -> Raster:
        head = read_range(path, 0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or struct.unpack(order + "H", head[2:4])[0] not in (42, 43):
            raise ValueError(f"{path} is no TIFF")
        big = struct.unpack(order + "H", head[2:4])[0] == 43
        at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        many = struct.unpack(order + ("Q" if big else "H"), read_range(path, at, 8 if big else 2))[0]
        step, inline = (20, 8) if big else (12, 4)
        raw = read_range(path, at + (8 if big else 2), many * step)
        tags: dict[int, object] = {}
        for k in range(many):
            tag, kind = struct.unpack_from(order + "2H", raw, k * step)
            n = struct.unpack_from(order + ("Q" if big else "I"), raw, k * step + 4)[0]
            size, where = n * _SIZES.get(kind, 1), k * step + step - inline
            data = raw[where : where + size] if size <= inline else read_range(path, struct.unpack_from(order + ("Q" if big else "I"), raw, where)[0], size)
            if kind == 2:
                tags[tag] = data.split(b"\0")[0].decode("ascii", "replace")
            elif kind in _CODES:
                tags[tag] = np.frombuffer(data, np.dtype(order + {"Q": "u8", "q": "i8", "I": "u4", "i": "i4", "H": "u2", "h": "i2", "B": "u1", "b": "i1", "f": "f4", "d": "f8"}[_CODES[kind]]))
        one = lambda tag, default=None: int(tags[tag][0]) if tag in tags else default
        if one(SAMPLES, 1) != 1:
            raise ValueError(f"{path} has more than one band")
        width, height, tiled = one(WIDTH), one(HEIGHT), TILES in tags
        compression = {32946: DEFLATE}.get(one(COMPRESSION, 1), one(COMPRESSION, 1))
        if compression not in (NONE, LZW, DEFLATE):
            raise ValueError(f"{path}: compression {compression} is not read")
        kind = "uif"[one(FORMAT, 1) - 1]
        no = str(tags.get(NODATA, "")).strip()
        frame = (float(tags[TIE][3] - tags[TIE][0] * tags[PIXEL][0]), float(tags[TIE][4] + tags[TIE][1] * tags[PIXEL][1]), float(tags[PIXEL][0]), float(tags[PIXEL][1])) if TIE in tags and PIXEL in tags else None
        return cls(path, width, height, one(TILE_WIDTH) if tiled else width, one(TILE_HEIGHT) if tiled else min(one(STRIP_ROWS, height), height), tags[TILES if tiled else STRIPS].astype(np.int64), tags[TILE_SIZES if tiled else STRIP_SIZES].astype(np.int64), np.dtype(f"{order}{kind}{one(BITS, 8) // 8}"), compression, one(PREDICTOR, 1), float(no) if no else None, frame)

    def tiles(self, low: tuple[float, float], high: tuple[float, float]) -> np.ndarray:
        """Numbers of the tiles with bytes that meet rows low[0] to high[0] and columns low[1] to high[1]."""
        r0, r1 = max(0, low[0]) // self.tile_height, min(self.height - 1, high[0]) // self.tile_height
        c0, c1 = max(0, low[1]) // self.tile_width, min(self.width - 1, high[1]) // self.tile_width
        if r1 < r0 or c1 < c0:
            return np.zeros(0, np.int64)
        found = (np.arange(int(r0), int(r1) + 1)[:, None] * self.across + np.arange(int(c0), int(c1) + 1)).ravel()
        return found[self.sizes[found] > 0]

    def cells(self, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and values of a tile's cells with data."""
        top, left = tile // self.across * self.tile_height, tile % self.across * self.tile_width
        size = self.tile_width * self.tile_height * self.dtype.itemsize
        raw = read_range(self.path, int(self.offsets[tile]), int(self.sizes[tile]))
        raw = raw if self.compression == NONE else unpack_lzw(raw, size) if self.compression == LZW else zlib.decompress(raw)
        high = min(self.tile_height, len(raw) // (self.tile_width * self.dtype.itemsize))
        if self.predictor == 3:  # bytes of one significance lie together, each the difference to the one before
            step = np.cumsum(np.frombuffer(raw, np.uint8, high * self.tile_width * self.dtype.itemsize).reshape(high, -1), axis=1, dtype=np.uint8)
            value = np.ascontiguousarray(step.reshape(high, self.dtype.itemsize, -1).transpose(0, 2, 1)).view(self.dtype.newbyteorder(">")).reshape(high, -1)
        else:
            value = np.frombuffer(raw, self.dtype, high * self.tile_width).reshape(high, self.tile_width)
            if self.predictor == 2:
                value = np.cumsum(value, axis=1, dtype=self.dtype.newbyteorder("="))
        value = value[: self.height - top, : self.width - left].astype(float)
        there = ~np.isnan(value)
        if self.nodata is not None:
            there &= value != (float(np.float32(self.nodata)) if self.dtype.itemsize == 4 and self.dtype.kind == "f" else self.nodata)
        r, c = np.nonzero(there)
        return r + top, c + left, value[r, c]


@dataclass
class _Tiles(InputPartition):
    tiles: list[int]


class _RasterReader(DataSourceReader):
    def __init__(self, raster: Raster, split: int, low: list[float], high: list[float]):
        self.raster, self.split, self.low, self.high = raster, split, low, high

    def partitions(self) -> list[_Tiles]:
        found = self.raster.tiles(tuple(self.low), tuple(self.high)).tolist()
        return [_Tiles(found[k : k + self.split]) for k in range(0, max(1, len(found)), self.split)]

    def read(self, part: _Tiles) -> Iterator[pa.RecordBatch]:
        for tile in part.tiles:
            r, c, v = self.raster.cells(tile)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(c, pa.int64()), pa.array(v)], names=CELLS.names)


class _FilteredReader(_RasterReader):
    """Comparisons of row and col with numbers choose the tiles; Spark still applies them to the cells."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            at = {("row",): 0, ("col",): 1}.get(getattr(f, "attribute", None))
            if at is not None and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[at] = max(self.low[at], f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[at] = min(self.high[at], f.value)
            yield f


@dataclass
class _Segment(WriterCommitMessage):
    """A task's file of tiles: their numbers and sizes, in the order of their bytes."""

    name: str
    tiles: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)


class _RasterWriter(DataSourceArrowWriter):
    """Two phases: each task packs whole tiles into a file of its own; the commit writes the header, copies the files one after the other,
    COPY bytes at a time, and ends with the directory. The target appears by a rename when it is whole."""

    def __init__(self, options: dict):
        self.path, self.width, self.height = options["path"], int(options["width"]), int(options["height"])
        self.compression = {"none": NONE, "lzw": LZW, "deflate": DEFLATE}[options.get("compression", "lzw")]
        self.nodata, self.tile = float(options.get("nodata", "nan")), int(options.get("tile", TILE))
        self.frame = [float(x) for x in options["frame"].split(",")] if options.get("frame") else None
        self.crs = int(options["epsg"]) if options.get("epsg") else None
        if self.tile % 16:
            raise ValueError("a tile's side must be a multiple of 16")
        self.run = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Segment:
        """The rows come by tile (`write_raster` sorts them); a tile ends where the next begins."""
        context = TaskContext.get()
        out = _Segment(f"{self.path}.{self.run}-{context.partitionId()}-{context.taskAttemptId()}")
        fs, path = filesystem(out.name)
        across, now, held = -(-self.width // self.tile), None, None
        with fs.open_output_stream(path) as f:

            def done() -> None:
                raw = pack(held.tobytes(), self.compression)
                f.write(raw)
                out.tiles.append(now)
                out.sizes.append(len(raw))

            for batch in batches:
                r, c, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                tile = r // self.tile * across + c // self.tile
                for part in np.split(np.arange(len(tile)), np.flatnonzero(np.diff(tile)) + 1):
                    if not len(part):
                        continue
                    if tile[part[0]] != now:
                        if now is not None:
                            done()
                        now, held = int(tile[part[0]]), np.full((self.tile, self.tile), self.nodata, "<f4")
                    held[r[part] % self.tile, c[part] % self.tile] = v[part]
            if now is not None:
                done()
        return out

    def commit(self, messages: list[_Segment | None]) -> None:
        segments = [m for m in messages if m is not None]
        across, down = -(-self.width // self.tile), -(-self.height // self.tile)
        offsets, sizes = np.zeros(across * down, np.int64), np.zeros(across * down, np.int64)
        big = sum(map(sum, (s.sizes for s in segments))) + 16 * len(offsets) + 1024 >= 1 << 32
        at = 16 if big else 8
        for s in segments:
            if len(set(s.tiles)) < len(s.tiles) or (sizes[s.tiles] > 0).any():
                raise ValueError("a tile's cells came from several tasks or out of order: use write_raster")
            ends = at + np.cumsum(s.sizes, dtype=np.int64)
            sizes[s.tiles], offsets[s.tiles] = s.sizes, ends - s.sizes
            at = int(ends[-1]) if len(ends) else at
        at += at % 2
        fs, path = filesystem(self.path)
        work = f"{path}.{self.run}"
        with fs.open_output_stream(work) as f:
            f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at))
            for s in segments:
                with fs.open_input_stream(filesystem(s.name)[1]) as source:
                    while raw := source.read(COPY):
                        f.write(raw)
            f.write(bytes(at - f.tell()))
            f.write(self.directory(at, offsets, sizes, big))
        fs.move(work, path)
        self.abort(segments)

    def directory(self, at: int, offsets: np.ndarray, sizes: np.ndarray, big: bool) -> bytes:
        number = "Q" if big else "I"
        long_ = 16 if big else 4
        tags: list[tuple[int, int, list]] = [
            (WIDTH, 4, [self.width]), (HEIGHT, 4, [self.height]), (BITS, 3, [32]), (COMPRESSION, 3, [self.compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1]),
            (TILE_WIDTH, 4, [self.tile]), (TILE_HEIGHT, 4, [self.tile]), (TILES, long_, offsets.tolist()), (TILE_SIZES, long_, sizes.tolist()), (FORMAT, 3, [3]),
        ]
        if self.frame:
            west, north, x, y = self.frame
            tags += [(PIXEL, 12, [x, y, 0.0]), (TIE, 12, [0.0, 0.0, 0.0, west, north, 0.0])]
        if self.crs:  # a geographic system's code in one key, a projected one's in another
            tags.append((GEO_KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if 4000 <= self.crs < 5000 else 1, 1025, 0, 1, 1, 2048 if 4000 <= self.crs < 5000 else 3072, 0, 1, self.crs]))
        text = f"{self.nodata:.17g}\0".encode()
        tags.append((NODATA, 2, [text]))
        inline, entries, extra = (8, b"", b"") if big else (4, b"", b"")
        after = at + (8 if big else 2) + len(tags) * (20 if big else 12) + inline
        for tag, kind, values in sorted(tags, key=lambda t: t[0]):
            data = values[0] if kind == 2 else struct.pack(f"<{len(values)}{_CODES[kind]}", *values)
            n = len(data) if kind == 2 else len(values)
            if len(data) > inline:
                place, extra = after + len(extra), extra + data + bytes(len(data) % 2)
                data = struct.pack(f"<{number}", place)
            entries += struct.pack(f"<HH{number}", tag, kind, n) + data.ljust(inline, b"\0")
        return struct.pack("<Q" if big else "<H", len(tags)) + entries + bytes(inline) + extra

    def abort(self, messages: list[_Segment | None]) -> None:
        for m in messages:
            if m is not None:
                fs, path = filesystem(m.name)
                fs.delete_file(path)


class GeoTiff(DataSource):
    """spark.read.format("keelgrid_geotiff").load(path): (row, col, value). Reading: option `split`, tiles a task; filters on row and col
    reach the tiles where Spark passes filters to Python sources (option `push`, if spark.sql.python.filterPushdown.enabled), and the options first_row, last_row, first_col and
    last_col always do. Writing: see write_raster."""

    @classmethod
    def name(cls) -> str:
        return "keelgrid_geotiff"

    def schema(self) -> T.StructType:
        return CELLS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        limit = lambda name, default: float(self.options.get(name, default))
        kind = _FilteredReader if self.options.get("push", "false") == "true" else _RasterReader
        return kind(Raster.of(self.options["path"]), int(self.options.get("split", SPLIT)), [limit("first_row", 0), limit("first_col", 0)], [limit("last_row", 1 << 40), limit("last_col", 1 << 40)])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _RasterWriter(dict(self.options))


def read_raster(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, split: int = SPLIT) -> DataFrame:
    """The cells of a GeoTIFF; of rows and columns from first to last, where they are given."""
    spark.dataSource.register(GeoTiff)
    read = spark.read.format("keelgrid_geotiff").option("split", split).option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    out = None
    for name, limits in (("row", rows), ("col", cols)):
        if limits:
            read = read.option(f"first_{name}", limits[0]).option(f"last_{name}", limits[1])
            here = F.col(name).between(*limits)
            out = here if out is None else out & here
    df = read.load(path)
    return df if out is None else df.where(out)


def write_raster(cells: DataFrame, path: str, width: int, height: int, tile: int = TILE, compression: str = "lzw", nodata: float = float("nan"), frame: tuple[float, float, float, float] | None = None, epsg: int | None = None) -> None:
    """One tiled GeoTIFF of 32-bit floats from (row, col, value); an existing file is replaced. Null values and cells outside are left out; of cells
    given twice one stays. frame: west, north, width and height of a cell.

    Tiles are dealt to tasks in ranges, so a task holds one tile at a time; the driver gets the tiles' sizes and copies
    what the tasks packed, COPY bytes at a time."""
    spark = cells.sparkSession
    spark.dataSource.register(GeoTiff)
    inside = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value")).where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1) & F.col("value").isNotNull())
    number = F.expr(f"row div {tile}") * -(-width // tile) + F.expr(f"col div {tile}")
    sorted_ = inside.withColumn("kg_tile", number).repartitionByRange("kg_tile").sortWithinPartitions("kg_tile", "row", "col").select("row", "col", "value")
    options = {"width": width, "height": height, "tile": tile, "compression": compression, "nodata": repr(float(nodata))}
    if frame:
        options["frame"] = ",".join(map(repr, map(float, frame)))
    if epsg:
        options["epsg"] = epsg
    sorted_.write.format("keelgrid_geotiff").options(**options).mode("append").save(path)


def sample_raster(cells: DataFrame, path: str, out: str = "value", split: int = SPLIT) -> DataFrame:
    """Adds the raster's value at each row's cell (row, col), null where it has none. Only the tiles between the cells' least and greatest row
    and column are read."""
    ends = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    rows, cols = ((ends[0], ends[1]), (ends[2], ends[3])) if ends[0] is not None and ends[2] is not None else ((0, -1), (0, -1))
    raster = read_raster(cells.sparkSession, path, rows, cols, split).select(F.col("row").alias("kg_r"), F.col("col").alias("kg_c"), F.col("value").alias(out))
    return cells.join(raster, (F.col("row") == F.col("kg_r")) & (F.col("col") == F.col("kg_c")), "left").drop("kg_r", "kg_c")
