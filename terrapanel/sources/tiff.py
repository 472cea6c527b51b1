"""Tiled raster files (TIFF with the GeoTIFF tags) as a Spark data source: partitions of tiles, read piece by piece.

``spark.dataSource.register(TiffSource)``, then ``spark.read.format("geotiff").load(folder)``.  To plan, only the directory of a
file is read; a task reads and decodes ``tiles`` (option, default 16) tiles or strips.  Uncompressed, LZW and deflate data of
whole or floating numbers are known, with or without horizontal differences; of several bands the first is read.  Rows are the
present cells (the file's no-data value and NaN stay out), ``iy`` counts from the south.

``write_tiff`` writes a file for each key and sheet of the grid, in LZW tiles.  A sheet is at most ``SHEET`` cells wide and
high, so a task's memory does not grow with the grid; each file is moved into place when it is whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.grid import Grid
from .files import listed, piece, put

SCHEMA = "file_name string, crs string, ix long, iy long, x double, y double, value double"
TILE, SHEET = 256, 4096
#: Tag numbers, the size of each field type, codes of compressions and of sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
GEOGRAPHIC_KEY, PROJECTED_KEY = 2048, 3072
KINDS = {1: "u", 2: "i", 3: "f"}
CLEAR, END, FIRST, LAST = 256, 257, 258, 4094


def lzw_decoded(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early."""
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    out, before, width, held, bits = [], b"", 9, 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == END:
            break
        if code == CLEAR:
            del table[FIRST:]
            before, width = b"", 9
            continue
        if before:
            now = table[code] if code < len(table) else before + before[:1]
            table.append(before + now[:1])
        else:
            now = table[code]
        out.append(now)
        before = now
        width = min(12, (len(table) + 1).bit_length())
    return b"".join(out)


def lzw_encoded(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put_code(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    number = lambda run: run[0] if len(run) == 1 else table[run]
    put_code(CLEAR)
    run = b""
    for i in range(len(data)):
        longer = run + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            run = longer
            continue
        put_code(number(run))
        table[longer] = FIRST + len(table)
        width = min(12, (FIRST + len(table)).bit_length())
        if FIRST + len(table) > LAST:
            put_code(CLEAR)
            table, width = {}, 9
        run = data[i : i + 1]
    if run:
        put_code(number(run))
        width = min(12, (FIRST + len(table) + 1).bit_length())
    put_code(END)
    if bits:
        out.append((held << (8 - bits)) & 0xFF)
    return bytes(out)


class Directory:
    """The first image of a file: its tags and where its tiles (or strips) lie."""

    def __init__(self, path: str):
        self.path = path
        head = piece(path, 0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        magic = struct.unpack(f"{self.order}H", head[2:4])[0] if self.order else 0
        if magic not in (42, 43):
            raise ValueError(f"{path}: not a TIFF file")
        self.big = magic == 43
        at = struct.unpack(f"{self.order}Q", head[8:16])[0] if self.big else struct.unpack(f"{self.order}I", head[4:8])[0]
        wide, size = (8, 20) if self.big else (2, 12)
        n = struct.unpack(self.order + ("Q" if self.big else "H"), piece(path, at, wide))[0]
        entries = piece(path, at + wide, n * size)
        self.tags = dict(self._entry(entries[i * size : (i + 1) * size]) for i in range(n))
        one = lambda tag, default: self.tags.get(tag, (default,))[0]
        self.width, self.height, self.compression, self.predictor = one(WIDTH, 0), one(HEIGHT, 0), one(COMPRESSION, NONE), one(PREDICTOR, 1)
        self.samples = one(SAMPLES, 1) if one(PLANAR, 1) == 1 else 1
        self.kind = np.dtype(f"{self.order}{KINDS[one(FORMAT, 1)]}{one(BITS, 8) // 8}")
        tiled = TILES in self.tags
        self.tile = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (self.width, min(self.height, one(ROWS, self.height)))
        self.offsets, self.sizes = (self.tags[TILES], self.tags[TILE_BYTES]) if tiled else (self.tags[STRIPS], self.tags[STRIP_BYTES])
        self.across, self.down = -(-self.width // self.tile[0]), -(-self.height // self.tile[1])
        scale, tie = self.tags.get(PIXEL_SCALE, (1.0, 1.0)), self.tags.get(TIE_POINT, (0.0, 0.0, 0.0, 0.0, float(self.height), 0.0))
        self.dx, self.dy = scale[0], scale[1]
        self.left, self.top = tie[3] - tie[0] * self.dx, tie[4] + tie[1] * self.dy
        nodata = self.tags.get(NODATA)
        self.nodata = float(nodata.rstrip("\0 ")) if nodata else None
        keys = self.tags.get(GEO_KEYS, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4) if keys[i + 1] == 0}
        code = found.get(PROJECTED_KEY) or found.get(GEOGRAPHIC_KEY)
        self.crs = f"EPSG:{code}" if code else "EPSG:4326"

    def _entry(self, raw: bytes):
        tag, kind = struct.unpack(f"{self.order}HH", raw[:4])
        n = struct.unpack(self.order + ("Q" if self.big else "I"), raw[4 : 12 if self.big else 8])[0]
        inline = raw[12 if self.big else 8 :]
        form = FIELD.get(kind)
        if form is None:
            return tag, ()
        size = n * struct.calcsize("=" + form)
        data = inline if size <= len(inline) else piece(self.path, struct.unpack(self.order + ("Q" if self.big else "I"), inline)[0], size)
        return tag, data[:n].decode("ascii", "replace") if form == "s" else struct.unpack(f"{self.order}{n}{form}", data[:size])

    def decoded(self, number: int) -> tuple[int, int, np.ndarray]:
        """Column and row (from the north) of a tile's corner, and its cells within the image."""
        row, column = divmod(number, self.across)
        wide, high = self.tile
        data = piece(self.path, self.offsets[number], self.sizes[number])
        if self.compression == LZW:
            data = lzw_decoded(data)
        elif self.compression in (DEFLATE, OLD_DEFLATE):
            data = zlib.decompress(data)
        elif self.compression != NONE:
            raise ValueError(f"{self.path}: compression {self.compression} is not known")
        high = min(high, len(data) // (wide * self.samples * self.kind.itemsize))  # the last strip is short
        cells = np.frombuffer(data, self.kind, high * wide * self.samples).reshape(high, wide, self.samples)
        if self.predictor == 2:
            cells = np.cumsum(cells, axis=1, dtype=self.kind)
        elif self.predictor != 1:
            raise ValueError(f"{self.path}: predictor {self.predictor} is not known")
        return column * wide, row * self.tile[1], cells[: self.height - row * self.tile[1], : self.width - column * wide, 0]


@dataclass
class Tiles(InputPartition):
    path: str
    first: int
    last: int


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Tiles]:
        step, out = int(self.options.get("tiles", 16)), []
        for path in listed(self.options["path"], self.options.get("glob", "*.tif")):
            d = Directory(path)
            out += [Tiles(path, a, min(a + step, d.across * d.down)) for a in range(0, d.across * d.down, step)]
        return out

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        d, name = Directory(partition.path), partition.path.rsplit("/", 1)[-1]
        for number in range(partition.first, partition.last):
            column, row, cells = d.decoded(number)
            values = cells.astype(float)
            here = np.isfinite(values) if d.nodata is None else np.isfinite(values) & (values != d.nodata)
            j, i = np.nonzero(here)
            ix, north = (column + i).astype(np.int64), (row + j).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(ix), pa.string()), pa.array([d.crs] * len(ix), pa.string()), pa.array(ix), pa.array(d.height - 1 - north), pa.array(d.left + (ix + 0.5) * d.dx), pa.array(d.top - (north + 0.5) * d.dy), pa.array(values[j, i])],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TiffReader:
        return TiffReader(dict(self.options))


def encoded(cells: np.ndarray, left: float, top: float, dx: float, dy: float, nodata: float, epsg: int = 4326, tile: int = TILE) -> bytes:
    """One band (rows from the north) in LZW tiles."""
    high, wide = cells.shape
    kind = cells.dtype.newbyteorder("<")
    tiles = []
    for a in range(0, high, tile):
        for b in range(0, wide, tile):
            whole = np.full((tile, tile), nodata, kind)
            part = cells[a : a + tile, b : b + tile]
            whole[: part.shape[0], : part.shape[1]] = part
            tiles.append(lzw_encoded(whole.tobytes()))
    text = f"{nodata:g}\0".encode()
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if epsg == 4326 else 1, 1025, 0, 1, 1, GEOGRAPHIC_KEY if epsg == 4326 else PROJECTED_KEY, 0, 1, epsg)
    number = next(k for k, v in KINDS.items() if v == kind.kind)
    fields: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (wide,)), (HEIGHT, 4, (high,)), (BITS, 3, (kind.itemsize * 8,)), (COMPRESSION, 3, (LZW,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (1,)), (TILE_WIDTH, 4, (tile,)), (TILE_HEIGHT, 4, (tile,)),
        (TILES, 4, (0,) * len(tiles)), (TILE_BYTES, 4, tuple(map(len, tiles))), (FORMAT, 3, (number,)), (PIXEL_SCALE, 12, (dx, dy, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, left, top, 0.0)), (GEO_KEYS, 3, keys), (NODATA, 2, (text,)),
    ]
    packed = lambda form, v: v[0] if form == "s" else struct.pack(f"<{len(v)}{form}", *v)
    after = 8 + 2 + 12 * len(fields) + 4
    sizes = [len(packed(FIELD[k], v)) for _, k, v in fields]
    begin = after + sum(s for s in sizes if s > 4)
    places = tuple(begin + sum(map(len, tiles[:i])) for i in range(len(tiles)))
    entries, more = [], b""
    for tag, form, values in fields:
        raw = packed(FIELD[form], places if tag == TILES else values)
        n = len(raw) if form == 2 else len(values)
        entries.append(struct.pack("<HHI", tag, form, n) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", after + len(more))))
        more += raw if len(raw) > 4 else b""
    return b"II*\0" + struct.pack("<IH", 8, len(fields)) + b"".join(entries) + b"\0" * 4 + more + b"".join(tiles)


def write_tiff(layers: DataFrame, folder: str, grid: Grid, key: str = "file", kind: str = "float32", nodata: float = -9999.0, epsg: int = 4326, sheet: int = SHEET) -> DataFrame:
    """Write (key, ix, iy, value) as ``folder``/<key>_<sheet column>_<sheet row>.tif; returns file_name and n_bytes.

    ``grid`` has the centre of the first cell.  ``kind`` is a NumPy type; values are rounded for whole numbers.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = int(rows["sx"].iloc[0]), int(rows["sy"].iloc[0])
        wide, high = min(sheet, grid.nx - a * sheet), min(sheet, grid.ny - b * sheet)
        cells = np.full((high, wide), nodata, kind)
        value = rows["value"].to_numpy(float)
        cells[high - 1 - (rows["iy"].to_numpy() - b * sheet), rows["ix"].to_numpy() - a * sheet] = np.rint(value) if np.dtype(kind).kind in "iu" else value
        left, top = grid.x0 + (a * sheet - 0.5) * grid.dx, grid.y0 + (b * sheet + high - 0.5) * grid.dy
        content, name = encoded(cells, left, top, grid.dx, grid.dy, nodata, epsg), f"{rows['file'].iloc[0]}_{a}_{b}.tif"
        put(f"{folder}/{name}", content)
        return pd.DataFrame({"file_name": [name], "n_bytes": [len(content)]})

    own = layers.where(F.col("value").isNotNull()).selectExpr(f"CAST(`{key}` AS STRING) AS file", "CAST(ix AS INT) AS ix", "CAST(iy AS INT) AS iy", "CAST(value AS DOUBLE) AS value", f"CAST(floor(ix / {sheet}) AS INT) AS sx", f"CAST(floor(iy / {sheet}) AS INT) AS sy")
    done = own.groupBy("file", "sx", "sy").applyInPandas(one, "file_name string, n_bytes long").collect()  # a row a file
    return layers.sparkSession.createDataFrame(done, "file_name string, n_bytes long")
