"""Classic NetCDF files as a Spark data source: a partition for each file, variable and time slice.

``read_netcdf(spark, folder)``, or the format "netcdf" after ``spark.dataSource.register(NetcdfSource)``.  Headers are read to
plan the slices; a task reads the bytes of its slice alone.  Options: ``variables`` (comma-separated), ``since`` and ``until``
(ISO times, both inclusive) leave slices out before anything of them is read; where Spark pushes filters to Python sources
(``spark.sql.python.filterPushdown.enabled``), conditions on variable and time do the same (option ``pushdown``).

Rows are the present cells: packed values are unpacked (``scale_factor``, ``add_offset``), fill values and NaN stay out.  The last
two dimensions are y and x, counted from the least coordinate; a leading one named ``time`` with units "... since ..." gives
``time``, other leading ones are counted in ``slice``.  ``crs`` is what the file names, else EPSG:4326.

``write_netcdf`` writes a file for each key, of float64 record variables over time, y and x.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.grid import Grid
from .files import listed, piece, put

SCHEMA = "file_name string, variable string, slice int, time timestamp, crs string, ix long, iy long, x double, y double, value double"
BATCH = 100_000
#: The format's numbers of types (NumPy's names, big-endian) and of lists.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
UNITS = {"day": 86_400, "hour": 3_600, "minute": 60, "second": 1}


@dataclass(frozen=True)
class Variable:
    name: str
    dims: tuple[int, ...]
    attributes: dict
    kind: str
    begin: int


class Header:
    """Dimensions, attributes and variables of a file."""

    def __init__(self, path: str):
        self.path, size = path, 1 << 16
        while True:
            self.data, self.at = piece(path, 0, size), 0
            try:
                return self._parse()
            except (struct.error, IndexError):
                if len(self.data) < size:
                    raise ValueError(f"{path}: the header ends early") from None
                size *= 4

    def _take(self, form: str):
        out = struct.unpack_from(">" + form, self.data, self.at)
        self.at += struct.calcsize(">" + form)
        return out[0]

    def _bytes(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise IndexError
        out = self.data[self.at : self.at + n]
        self.at += -(-n // 4) * 4
        return out

    def _name(self) -> str:
        return self._bytes(self._take(self.count)).decode()

    def _list(self, tag: int, one) -> list:
        found, n = self._take("i"), self._take(self.count)
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError(f"{self.path}: not a classic header")
        return [one() for _ in range(n)]

    def _attribute(self):
        name, kind, n = self._name(), TYPES[self._take("i")], self._take(self.count)
        raw = self._bytes(n * np.dtype(kind).itemsize)
        return name, raw.decode("utf-8", "replace").rstrip("\0") if kind == "S1" else np.frombuffer(raw, kind)

    def _variable(self) -> Variable:
        name = self._name()
        dims = tuple(self._take(self.count) for _ in range(self._take(self.count)))
        attributes, kind = dict(self._list(ATTRIBUTES, self._attribute)), TYPES[self._take("i")]
        self._take(self.count)  # the size is worked out from the dimensions
        return Variable(name, dims, attributes, kind, self._take("q" if self.version > 1 else "i"))

    def _parse(self) -> None:
        if self._bytes(4)[:3] != b"CDF":
            raise ValueError(f"{self.path}: not a classic NetCDF file")
        self.version = self.data[3]
        self.count = "q" if self.version == 5 else "i"
        self.records = self._take(self.count)
        self.dims = self._list(DIMENSIONS, lambda: (self._name(), self._take(self.count)))
        self.attributes = dict(self._list(ATTRIBUTES, self._attribute))
        self.variables = {v.name: v for v in self._list(VARIABLES, self._variable)}
        held = [v for v in self.variables.values() if self.recorded(v)]
        padded = [-(-self.row(v) // 4) * 4 for v in held]
        self.record = self.row(held[0]) if len(held) == 1 else sum(padded)

    def recorded(self, v: Variable) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]][1] == 0

    def length(self, dim: int) -> int:
        return self.dims[dim][1] or self.records

    def row(self, v: Variable) -> int:
        """Bytes of a variable, or of one record of it."""
        return math.prod(self.dims[d][1] for d in v.dims[int(self.recorded(v)) :]) * np.dtype(v.kind).itemsize

    def place(self, v: Variable, index: int, inner: int) -> int:
        """Where the ``index``-th block of ``inner`` values over the leading dimensions begins."""
        size = inner * np.dtype(v.kind).itemsize
        if not self.recorded(v):
            return v.begin + index * size
        per = max(1, self.row(v) // size)
        return v.begin + index // per * self.record + index % per * size

    def axis(self, dim: int) -> np.ndarray:
        """The coordinates of a dimension; its numbers where it has none."""
        v, n = self.variables.get(self.dims[dim][0]), self.length(dim)
        if v is None or v.dims != (dim,) or v.kind == "S1":
            return np.arange(n, dtype=float)
        if self.recorded(v):
            return np.array([np.frombuffer(piece(self.path, self.place(v, i, 1), np.dtype(v.kind).itemsize), v.kind)[0] for i in range(n)], float)
        return np.frombuffer(piece(self.path, v.begin, self.row(v)), v.kind).astype(float)

    def times(self, dim: int) -> list[datetime | None]:
        v = self.variables.get(self.dims[dim][0])
        m = re.match(r"\s*(day|hour|minute|second)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T\s]+(\d+):(\d+)(?::(\d+))?)?", str(v.attributes.get("units", "")) if v else "")
        if not m:
            return [None] * self.length(dim)
        start = datetime(*(int(g or 0) for g in m.groups()[1:]))
        return [start + timedelta(seconds=round(float(t) * UNITS[m[1]], 6)) for t in self.axis(dim)]

    def crs(self) -> str:
        for attributes in (*(v.attributes for v in self.variables.values()), self.attributes):
            for name in ("crs", "spatial_ref", "crs_wkt"):
                if isinstance(attributes.get(name), str):
                    return attributes[name]
        return "EPSG:4326"


@dataclass
class Slice(InputPartition):
    path: str
    variable: str
    number: int
    time: datetime | None
    start: int
    kind: str
    x: np.ndarray
    y: np.ndarray
    scale: float
    offset: float
    missing: tuple[float, ...]
    crs: str


class NetcdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.names = {n.strip() for n in options.get("variables", "").split(",") if n.strip()} or None
        self.since, self.until = (datetime.fromisoformat(options[k]) if k in options else None for k in ("since", "until"))

    def _wanted(self, time: datetime | None) -> bool:
        if self.since is None and self.until is None:
            return True
        return time is not None and (self.since is None or time >= self.since) and (self.until is None or time <= self.until)

    def partitions(self) -> list[Slice]:
        out = []
        for path in listed(self.options["path"], self.options.get("glob", "*.nc")):
            h = Header(path)
            for v in h.variables.values():
                if len(v.dims) < 2 or v.kind == "S1" or (self.names is not None and v.name not in self.names):
                    continue
                lead, (dy, dx) = v.dims[:-2], v.dims[-2:]
                x, y = h.axis(dx), h.axis(dy)
                at = next((k for k, d in enumerate(lead) if h.dims[d][0].lower() == "time"), None)
                times = h.times(lead[at]) if at is not None else [None]
                number = lambda name, default: float(v.attributes[name][0]) if name in v.attributes else default  # noqa: E731, B023
                missing = tuple(float(m) for name in ("_FillValue", "missing_value") if not isinstance(v.attributes.get(name, ""), str) for m in v.attributes[name])
                shape = [h.length(d) for d in lead]
                for i in range(math.prod(shape)):
                    time = times[np.unravel_index(i, shape)[at]] if at is not None else None
                    if self._wanted(time):
                        out.append(Slice(path, v.name, i, time, h.place(v, i, len(x) * len(y)), v.kind, x, y, number("scale_factor", 1.0), number("add_offset", 0.0), missing, h.crs()))
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        s, names = partition, [c.split()[0] for c in SCHEMA.split(", ")]
        nx, ny = len(s.x), len(s.y)
        raw = np.frombuffer(piece(s.path, s.start, nx * ny * np.dtype(s.kind).itemsize), s.kind).reshape(ny, nx).astype(float)
        here = np.isfinite(raw) & ~np.isin(raw, s.missing)
        flip = lambda at, axis: len(axis) - 1 - at if len(axis) > 1 and axis[0] > axis[-1] else at
        j, i = np.nonzero(here)
        values = raw[j, i] * s.scale + s.offset
        name = s.path.rsplit("/", 1)[-1]
        for a in range(0, len(i), BATCH):
            c, r = i[a : a + BATCH], j[a : a + BATCH]
            same = lambda v, kind: pa.array([v] * len(c), kind)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [same(name, pa.string()), same(s.variable, pa.string()), same(s.number, pa.int32()), same(s.time, pa.timestamp("us", tz="UTC")), same(s.crs, pa.string()), pa.array(flip(c, s.x)), pa.array(flip(r, s.y)), pa.array(s.x[c]), pa.array(s.y[r]), pa.array(values[a : a + BATCH])],
                names=names,
            )


class PushingReader(NetcdfReader):
    """With pushed filters; Spark refuses such a reader unless pushing is switched on."""

    def pushFilters(self, filters: list) -> Iterator:
        """Conditions on variable and time choose slices; Spark checks every condition again on the rows."""
        for f in filters:
            kind, column, value = type(f).__name__, getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("variable",) and kind in ("EqualTo", "In"):
                wanted = {value} if kind == "EqualTo" else set(value)
                self.names = wanted if self.names is None else self.names & wanted
            elif column == ("time",) and isinstance(value, datetime):
                bare = value.replace(tzinfo=None)
                if kind in ("EqualTo", "GreaterThan", "GreaterThanOrEqual"):
                    self.since = bare if self.since is None else max(self.since, bare)
                if kind in ("EqualTo", "LessThan", "LessThanOrEqual"):
                    self.until = bare if self.until is None else min(self.until, bare)
            yield f


class NetcdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NetcdfReader:
        return (PushingReader if self.options.get("pushdown") == "true" else NetcdfReader)(dict(self.options))


def read_netcdf(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(NetcdfSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("netcdf").options(**{"pushdown": pushed} | options).load(path)


def _text(name: str) -> bytes:
    raw = name.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def encoded(x: np.ndarray, y: np.ndarray, days: np.ndarray, cubes: dict[str, np.ndarray], start: str = "1970-01-01", crs: str = "EPSG:4326", fill: float = -9.999e33) -> bytes:
    """A CDF-2 file: float64 variables by time (the record dimension), y and x; NaN is written as ``fill``."""
    texts = lambda items: struct.pack(">ii", ATTRIBUTES, len(items)) + b"".join(_text(k) + (struct.pack(">i", 2) + _text(v) if isinstance(v, str) else struct.pack(">iid", 6, 1, v)) for k, v in items.items()) if items else b"\0" * 8
    head = b"CDF\x02" + struct.pack(">i", len(days)) + struct.pack(">ii", DIMENSIONS, 3) + b"".join(_text(n) + struct.pack(">i", k) for n, k in (("time", 0), ("y", len(y)), ("x", len(x)))) + texts({"crs": crs})
    entries = [("y", (1,), {}, len(y) * 8), ("x", (2,), {}, len(x) * 8), ("time", (0,), {"units": f"days since {start}"}, 8), *((n, (0, 1, 2), {"_FillValue": fill}, len(y) * len(x) * 8) for n in cubes)]

    def listing(begins: list[int]) -> bytes:
        rows = (_text(n) + struct.pack(f">i{len(d)}i", len(d), *d) + texts(a) + struct.pack(">iiq", 6, min(size, 2**31 - 4), b) for (n, d, a, size), b in zip(entries, begins, strict=True))
        return struct.pack(">ii", VARIABLES, len(entries)) + b"".join(rows)

    begins, at = [], len(head) + len(listing([0] * len(entries)))
    for _, _, _, size in entries:  # fixed variables, then the first record's share of each other
        begins.append(at)
        at += size
    parts = [head, listing(begins), np.asarray(y, ">f8").tobytes(), np.asarray(x, ">f8").tobytes()]
    for t, day in enumerate(days):
        parts += [np.asarray([day], ">f8").tobytes(), *(np.where(np.isnan(c[t]), fill, c[t]).astype(">f8").tobytes() for c in cubes.values())]
    return b"".join(parts)


def write_netcdf(layers: DataFrame, folder: str, grid: Grid, key: str = "file", crs: str = "EPSG:4326") -> DataFrame:
    """Write (key, variable, time, ix, iy, value) as ``folder``/<key>.nc; returns file_name and n_bytes once they are there.

    A file's rows meet in one task: choose keys (a year, a month) whose layers fit in its memory.
    """
    x, y = grid.x0 + np.arange(grid.nx) * grid.dx, grid.y0 + np.arange(grid.ny) * grid.dy
    start = pd.Timestamp("1970-01-01")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(rows["time"].unique())
        names = sorted(rows["variable"].unique())
        cubes = {n: np.full((len(times), grid.ny, grid.nx), np.nan) for n in names}
        for n, own in rows.groupby("variable"):
            cubes[n][np.searchsorted(times, own["time"].to_numpy()), own["iy"].to_numpy(), own["ix"].to_numpy()] = own["value"].to_numpy(float)
        content = encoded(x, y, (pd.DatetimeIndex(times).tz_localize(None) - start) / pd.Timedelta(days=1), cubes, crs=crs)
        name = f"{rows['file'].iloc[0]}.nc"
        put(f"{folder}/{name}", content)
        return pd.DataFrame({"file_name": [name], "n_bytes": [len(content)]})

    own = layers.selectExpr(f"CAST(`{key}` AS STRING) AS file", "variable", "CAST(time AS TIMESTAMP) AS time", "CAST(ix AS INT) AS ix", "CAST(iy AS INT) AS iy", "CAST(value AS DOUBLE) AS value")
    done = own.groupBy("file").applyInPandas(one, "file_name string, n_bytes long").collect()  # a row a file
    return layers.sparkSession.createDataFrame(done, "file_name string, n_bytes long")


def layer_name(variable: str = "variable", time: str = "time") -> str:
    """SQL for the name of a layer: the variable and its year and month, or the variable alone."""
    return f"concat({variable}, coalesce(date_format({time}, 'yyyy-MM'), ''))"
