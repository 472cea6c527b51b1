"""Layers and boundaries from plain files: ASCII grids as pixel tables, WKT polygons and shapefiles as vertex tables.

An ASCII grid has a header (ncols, nrows, xllcorner, yllcorner, cellsize, NODATA_value, in any order) and nrows lines of
values from the north down.  Files are dealt over tasks and decoded where they are read; a file's pixels leave its task in
bounded batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import stamp_from_name

PIXELS = "file_name string, ix long, iy long, x double, y double, value double"
BATCH = 100_000
RING = r"\(([^()]+)\)"


def decoded(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x and y of the columns and rows (cell centres, rows from the south) and the values; missing ones are NaN."""
    lines = content.decode("ascii").split("\n")
    header: dict[str, float] = {}
    while lines and lines[0][:1].isalpha():
        key, value = lines.pop(0).split()
        header[key.lower()] = float(value)
    nx, ny, size = int(header["ncols"]), int(header["nrows"]), header["cellsize"]
    values = np.array(" ".join(lines).split(), float)
    if len(values) != nx * ny:
        raise ValueError(f"grid of {nx} x {ny} cells has {len(values)} values")
    values = values.reshape(ny, nx)[::-1]
    values = np.where(values == header.get("nodata_value", -9999.0), np.nan, values)
    return header["xllcorner"] + (np.arange(nx) + 0.5) * size, header["yllcorner"] + (np.arange(ny) + 0.5) * size, values


def read_grids(spark: SparkSession, path: str, glob: str = "*.asc") -> DataFrame:
    """file_name, year and month (from a name that carries YYYYDDD or YYYYMM), ix, iy, x, y, value of every present cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y, values = decoded(content)
                iy, ix = np.nonzero(np.isfinite(values))
                for a in range(0, len(ix), BATCH):
                    i, j = ix[a : a + BATCH], iy[a : a + BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array(i), pa.array(j), pa.array(x[i]), pa.array(y[j]), pa.array(values[j, i])], [c.split()[0] for c in PIXELS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content").mapInArrow(run, PIXELS)
    return rows.withColumns(stamped(F.col("file_name")))


def stamped(name: Column) -> dict[str, Column]:
    """year and month: YYYYDDD if there are seven digits, else YYYYMM with an optional sign between them."""
    by_day, short = stamp_from_name(name), r"(\d{4})[-_]?(\d{2})(?!\d)"
    part = lambda i: F.regexp_extract(name, short, i).try_cast("int")
    return {"year": F.coalesce(by_day["year"], part(1)), "month": F.coalesce(by_day["month"], part(2))}


def vertices(shapes: DataFrame, wkt: str = "wkt") -> DataFrame:
    """ring_id, seq, x, y of all rings of POLYGON and MULTIPOLYGON texts; a ring's closing vertex is left out."""
    rings = shapes.select(F.monotonically_increasing_id().alias("shape"), F.posexplode(F.regexp_extract_all(wkt, F.lit(RING), F.lit(1))).alias("ring", "text"))
    points = rings.select(F.xxhash64("shape", "ring").alias("ring_id"), F.posexplode(F.split(F.trim("text"), r"\s*,\s*")).alias("seq", "point"), F.size(F.split("text", ",")).alias("n"))
    place = F.split(F.trim("point"), r"\s+")
    return points.where((F.col("seq") < F.col("n") - 1) | (F.col("n") == 1)).select("ring_id", "seq", place[0].cast("double").alias("x"), place[1].cast("double").alias("y"))


#: A shapefile's number and the kinds of polygons (plain, with z, with m).
SHAPEFILE, POLYGONS = 9994, (5, 15, 25)
RINGS = "path string, record int, ring int, seq int, x double, y double"


def shape_rings(content: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(record, ring, points) of a shapefile's polygons; z and m values and other kinds of shapes are passed over."""
    if len(content) < 100 or struct.unpack(">i", content[:4])[0] != SHAPEFILE:
        raise ValueError("not a shapefile")
    at, upto = 100, min(len(content), 2 * struct.unpack(">i", content[24:28])[0])
    while at + 12 <= upto:
        record, words = struct.unpack(">ii", content[at : at + 8])
        body, at = at + 8, at + 8 + 2 * words
        if struct.unpack_from("<i", content, body)[0] not in POLYGONS:
            continue
        n_parts, n_points = struct.unpack_from("<ii", content, body + 36)
        parts = [*struct.unpack_from(f"<{n_parts}i", content, body + 44), n_points]
        points = np.frombuffer(content, "<f8", 2 * n_points, body + 44 + 4 * n_parts).reshape(-1, 2)
        yield from ((record, ring, points[a:z]) for ring, (a, z) in enumerate(zip(parts[:-1], parts[1:], strict=True)))


def shapefile(polygons: list[list[list[tuple[float, float]]]]) -> bytes:
    """A shapefile of polygons, each a list of closed rings."""
    records = []
    for number, rings in enumerate(polygons, 1):
        points = np.array([p for r in rings for p in r], "<f8")
        starts = np.cumsum([0, *(len(r) for r in rings[:-1])])
        body = struct.pack("<i4d2i", 5, *points.min(axis=0), *points.max(axis=0), len(rings), len(points)) + starts.astype("<i4").tobytes() + points.tobytes()
        records.append((struct.pack(">ii", number, len(body) // 2) + body, points))
    every = np.concatenate([p for _, p in records]) if records else np.zeros((1, 2))
    size = 100 + sum(len(r) for r, _ in records)
    head = struct.pack(">7i", SHAPEFILE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, 5, *every.min(axis=0), *every.max(axis=0), 0, 0, 0, 0)
    return head + b"".join(r for r, _ in records)


def read_shapes(spark: SparkSession, path: str, glob: str = "*.shp") -> DataFrame:
    """ring_id, seq, x, y of all polygon rings of the files, as ``vertices`` gives them, with file_name and crs.

    ``crs`` is the text of the .prj file of the same name, else EPSG:4326.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for record, ring, points in shape_rings(content):
                    open_ = points[:-1] if len(points) > 1 and (points[0] == points[-1]).all() else points
                    for a in range(0, len(open_), BATCH):
                        own = open_[a : a + BATCH]
                        same = lambda v, kind: pa.array([v] * len(own), kind)  # noqa: E731, B023
                        yield pa.RecordBatch.from_arrays([same(name, pa.string()), same(record, pa.int32()), same(ring, pa.int32()), pa.array(np.arange(a, a + len(own), dtype=np.int32)), pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy())], [c.split()[0] for c in RINGS.split(", ")])

    def files(pattern: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
        return found.select("path", F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"), "content")

    shapes = files(glob)
    rings = shapes.select("path", "content").mapInArrow(run, RINGS)
    named = shapes.select("path", "stem").join(files("*.prj").select("stem", F.decode("content", "UTF-8").alias("crs")), "stem", "left").select("path", F.coalesce("crs", F.lit("EPSG:4326")).alias("crs"))
    return rings.join(named, "path").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.xxhash64("path", "record", "ring").alias("ring_id"), "seq", "x", "y", "crs")
