"""Gridded and vector files: NetCDF slices, tiled rasters, shapefiles and scanline runs."""

import random
import struct
import zlib
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrapanel.functions.grid import Grid
from terrapanel.operators import raster
from terrapanel.sources import netcdf, tiff
from terrapanel.sources.files import listed, piece, put
from terrapanel.sources.layers import read_shapes, shapefile


def name(text: str) -> bytes:
    return struct.pack(">i", len(text)) + text.encode() + b"\0" * (-len(text) % 4)


def packed_file() -> bytes:
    """CDF-1 by hand: a packed short record variable with a fill value, latitudes from the north, hours since a date, one level."""
    att = struct.pack(">ii", 12, 3) + name("scale_factor") + struct.pack(">iid", 6, 1, 0.5) + name("add_offset") + struct.pack(">iif", 5, 1, 10.0) + name("_FillValue") + struct.pack(">iih", 3, 1, -99) + b"\0\0"
    units = struct.pack(">ii", 12, 1) + name("units") + struct.pack(">i", 2) + name("hours since 1999-12-31 00:00:00")
    none = struct.pack(">ii", 0, 0)
    head = b"CDF\x01" + struct.pack(">i", 2) + struct.pack(">ii", 10, 3) + name("time") + struct.pack(">i", 0) + name("lat") + struct.pack(">i", 3) + name("lon") + struct.pack(">i", 3) + none
    data = [np.array([50, 40, 30], ">f4"), np.array([1, 2, 3], ">f4")]
    times, cubes = np.array([24, 24 * 32], ">i4"), np.arange(18, dtype=">i2").reshape(2, 3, 3)
    cubes[1, 0, 2] = -99

    def variables(places):
        v = [(b"", name("lat") + struct.pack(">ii", 1, 1) + none + struct.pack(">ii", 5, 12)), (b"", name("lon") + struct.pack(">ii", 1, 2) + none + struct.pack(">ii", 5, 12)), (b"", name("time") + struct.pack(">ii", 1, 0) + units + struct.pack(">ii", 4, 4)), (b"", name("t2m") + struct.pack(">iiii", 3, 0, 1, 2) + att + struct.pack(">ii", 3, 20))]
        return struct.pack(">ii", 11, 4) + b"".join(b + struct.pack(">i", p) for (_, b), p in zip(v, places, strict=True))

    start = len(head) + len(variables([0] * 4))
    body = b"".join(d.tobytes() for d in data) + b"".join(times[i : i + 1].tobytes() + cubes[i].tobytes() + b"\0\0" for i in range(2))
    return head + variables([start, start + 12, start + 24, start + 28]) + body


def test_netcdf_of_packed_values(spark, tmp_path):
    put(f"file:{tmp_path}/deep/a.nc", packed_file())
    assert listed(str(tmp_path), "*.nc") == [f"{tmp_path}/deep/a.nc"] and piece(f"{tmp_path}/deep/a.nc", 0, 3) == b"CDF"
    rows = netcdf.read_netcdf(spark, str(tmp_path)).toPandas()
    assert len(rows) == 17 and set(rows.crs) == {"EPSG:4326"} and set(rows.variable) == {"t2m"}
    at = {(r.slice, r.ix, r.iy): (r.x, r.y, r.value) for r in rows.itertuples()}
    assert at[0, 0, 2] == (1, 50, 10) and at[1, 1, 0] == (2, 30, 10 + 16 / 2) and (1, 2, 2) not in at
    assert sorted(set(rows.time.dt.strftime("%Y-%m-%d"))) == ["2000-01-01", "2000-02-01"]
    assert [r[0] for r in netcdf.read_netcdf(spark, str(tmp_path)).select(F.expr(netcdf.layer_name())).distinct().orderBy(F.expr(netcdf.layer_name())).collect()] == ["t2m2000-01", "t2m2000-02"]


def test_netcdf_reads_wanted_slices_only(spark, tmp_path):
    days = pd.to_datetime(["2001-01-01", "2001-02-01", "2002-01-01"])
    cells = pd.DataFrame([(f"f{d.year}", v, d, i, j, float(i + 10 * j + (v == "b") * 100)) for d in days for v in "ab" for i in range(3) for j in range(2) if (i, j) != (1, 1)], columns=["file", "variable", "time", "ix", "iy", "value"])
    wrote = netcdf.write_netcdf(spark.createDataFrame(cells), str(tmp_path), Grid(0.5, 1.0, 7.0, 3.0, 3, 2), crs="local")
    assert {(r.file_name, r.n_bytes == len((tmp_path / r.file_name).read_bytes())) for r in wrote.collect()} == {("f2001.nc", True), ("f2002.nc", True)}
    got = netcdf.read_netcdf(spark, str(tmp_path)).toPandas()
    key = lambda t: sorted(zip(t.variable, t.time.dt.strftime("%F"), t.ix, t.iy, t.value, strict=True))
    assert key(got) == key(cells) and set(got.crs) == {"local"} and set(got.x) == {7.0, 7.5, 8.0} and set(got.y) == {3.0, 4.0}
    plan = lambda **o: netcdf.NetcdfReader({"path": str(tmp_path)} | o).partitions()
    assert len(plan()) == 6 and len(plan(variables="b, x")) == 3
    assert {(p.variable, p.time) for p in plan(since="2001-02-01", until="2001-12-31")} == {("a", datetime(2001, 2, 1)), ("b", datetime(2001, 2, 1))}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = netcdf.read_netcdf(spark, str(tmp_path)).where("variable = 'a' and time >= timestamp'2001-02-01'")
        assert pushed.count() == 10 and pushed.rdd.getNumPartitions() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_broken_files_are_named(tmp_path):
    for content, reader in ((b"CDF\x01" + b"\0" * 7, netcdf.Header), (b"HDF5....", netcdf.Header), (b"XX*\0" + b"\0" * 12, tiff.Directory)):
        put(f"{tmp_path}/x", content)
        with pytest.raises(ValueError, match="x: "):
            reader(f"{tmp_path}/x")


def test_lzw_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 300, 5000, 40_000):
        for letters in (1, 2, 5, 256):
            data = bytes(rng.randrange(letters) for _ in range(n))
            assert tiff.lzw_decoded(tiff.lzw_encoded(data)) == data
    # the example of the TIFF 6.0 specification: 7 7 7 8 8 7 7 6 6 as codes 256 7 258 8 8 258 6 6 257
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    assert tiff.lzw_encoded(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def striped(cells: np.ndarray, order: str, predictor: int) -> bytes:
    """Deflated strips of two rows in either byte order, with two bands."""
    kind = cells.dtype.newbyteorder(order)
    whole = np.stack([cells, cells + 1], axis=2).astype(kind)
    if predictor == 2:
        whole = np.concatenate([whole[:, :1], np.diff(whole, axis=1)], axis=1).astype(kind)
    strips = [zlib.compress(whole[a : a + 2].tobytes()) for a in range(0, len(cells), 2)]
    entries = [(256, 3, [cells.shape[1]]), (257, 3, [len(cells)]), (258, 3, [16, 16]), (259, 3, [8]), (273, 4, [0] * len(strips)), (277, 3, [2]), (278, 3, [2]), (279, 4, [len(s) for s in strips]), (317, 3, [predictor]), (339, 3, [2, 2])]
    begin = 8 + 2 + 12 * len(entries) + 4 + 8 * len(strips)
    places = [begin + sum(map(len, strips[:i])) for i in range(len(strips))]
    out, more = b"", b""
    for tag, form, values in entries:
        raw = struct.pack(f"{order}{len(values)}{tiff.FIELD[form]}", *(places if tag == 273 else values))
        out += struct.pack(f"{order}HHI", tag, form, len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{order}I", begin - 8 * len(strips) + len(more)))
        more += raw if len(raw) > 4 else b""
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HIH", 42, 8, len(entries)) + out + b"\0" * 4 + more.ljust(8 * len(strips), b"\0") + b"".join(strips)


@pytest.mark.parametrize(("order", "predictor"), [("<", 1), (">", 2)])
def test_strips_of_other_writers(order, predictor, tmp_path):
    cells = np.random.default_rng(3).integers(-3000, 3000, (5, 7)).astype("i2")
    put(f"{tmp_path}/s.tif", striped(cells, order, predictor))
    d = tiff.Directory(f"{tmp_path}/s.tif")
    assert (d.across, d.down, d.nodata) == (1, 3, None)
    assert np.array_equal(np.concatenate([d.decoded(i)[2] for i in range(3)]), cells)


def test_tiled_rasters_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    cells = pd.DataFrame([(k, i, j, float(rng.integers(0, 9)) if k == "class" else float(np.float32(rng.normal()))) for k in ("class", "level") for i in range(300) for j in range(40) if rng.random() < 0.7], columns=["file", "ix", "iy", "value"])
    grid, df = Grid(0.5, 0.25, 10.0, 20.0, 300, 40), spark.createDataFrame(cells)
    names = {r.file_name for r in tiff.write_tiff(df.where("file = 'class'"), str(tmp_path), grid, kind="uint8", nodata=255, sheet=280).collect()} | {r.file_name for r in tiff.write_tiff(df.where("file = 'level'"), str(tmp_path), grid).collect()}
    assert names == {"class_0_0.tif", "class_1_0.tif", "level_0_0.tif"}
    spark.dataSource.register(tiff.TiffSource)
    read = spark.read.format("geotiff").option("tiles", 1).load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 5  # two tiles in each wide file, one in the narrow one
    got = read.toPandas()
    assert set(got.crs) == {"EPSG:4326"}
    whole = got.assign(file=got.file_name.str.split("_").str[0], cx=((got.x - 10) / 0.5).round().astype(int), cy=((got.y - 20) / 0.25).round().astype(int))
    assert sorted(zip(whole.file, whole.cx, whole.cy, whole.value, strict=True)) == sorted(zip(cells.file, cells.ix, cells.iy, cells.value, strict=True))
    level = whole[whole.file == "level"]
    assert (level.ix == level.cx).all() and (level.iy == level.cy).all()


def test_shapefile_rings(spark, tmp_path):
    square = lambda a, b, s: [(a, b), (a, b + s), (a + s, b + s), (a + s, b), (a, b)]
    put(f"{tmp_path}/land.shp", shapefile([[square(0, 0, 10), square(2, 2, 3)], [square(20, 20, 1)]]))
    put(f"{tmp_path}/other.shp", shapefile([[square(5, 5, 1)]]))
    put(f"{tmp_path}/land.prj", b'PROJCS["x"]')
    got = read_shapes(spark, str(tmp_path)).toPandas()
    assert got.groupby("file_name").crs.first().to_dict() == {"land.shp": 'PROJCS["x"]', "other.shp": "EPSG:4326"}
    assert sorted(got.groupby("ring_id").seq.apply(sorted).tolist()) == [[0, 1, 2, 3]] * 4
    land = read_shapes(spark, f"{tmp_path}/land.shp")
    cells = {(r.iy, x) for r in raster.scanlines(land, Grid(1, 1, 0.5, 0.5, 40, 40)).collect() for x in range(r.first, r.last + 1)}
    assert (3, 3) not in cells and {(0, 0), (1, 1), (2, 2), (20, 20)} <= cells and (15, 15) not in cells


def test_scanlines_against_cell_by_cell(spark):
    rng = random.Random(4)
    for k in range(3):
        ring = [(0, i, rng.uniform(-2, 14), rng.uniform(-2, 14)) for i in range(7)] + [(1, i, x, y) for i, (x, y) in enumerate([(3.5, 3.5), (8.5, 3.5), (8.5, 6.0), (3.5, 6.0)])]
        grid = Grid(1.0, 1.0, 0.0, 0.0, 12, 12)
        runs = raster.scanlines(spark.createDataFrame(ring, "ring_id int, seq int, x double, y double"), grid).collect()
        got = {(x, r.iy) for r in runs for x in range(r.first, r.last + 1)}
        edges = [(a, b) for i in (0, 1) for p in [[r[2:] for r in ring if r[0] == i]] for a, b in zip(p, [*p[1:], p[0]], strict=True)]
        want = set()
        for i in range(12):
            for j in range(12):
                crossed = sum((y1 > j) != (y2 > j) and i < (x2 - x1) * (j - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in edges)
                meets = False
                for (x1, y1), (x2, y2) in edges:
                    side = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (i - 0.5, i + 0.5) for y in (j - 0.5, j + 0.5)]
                    meets |= min(x1, x2) <= i + 0.5 and max(x1, x2) >= i - 0.5 and min(y1, y2) <= j + 0.5 and max(y1, y2) >= j - 0.5 and min(side) <= 0 <= max(side)
                if crossed % 2 or meets:
                    want.add((i, j))
        assert got == want
