"""Regular grids: spacing, pixel and block ids, coordinate rounding, Albers projection."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ID_BASE = 10_000_000


@dataclass(frozen=True)
class Grid:
    dx: float
    dy: float
    x0: float
    y0: float
    nx: int = 0
    ny: int = 0


def axis_info(df: DataFrame, axis: str) -> DataFrame:
    """One row: spacing (median difference of sorted distinct values), least and largest value, count.

    The window runs over the axis' distinct values, of which a grid has few; the rows are made distinct first.
    """
    v = df.select(F.col(axis).cast("double").alias("v")).where("v is not null").distinct()
    gap = v.withColumn("gap", F.col("v") - F.lag("v").over(W.orderBy("v")))
    return gap.agg(F.percentile("gap", F.lit(0.5)).alias("spacing"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n"))


def grid_of(df: DataFrame, x: str = "x", y: str = "y") -> Grid:
    """The grid of a panel; four numbers come to the driver."""
    a, b = axis_info(df, x).first(), axis_info(df, y).first()
    dx, dy = a["spacing"] or 1.0, b["spacing"] or 1.0
    if not a["n"]:
        return Grid(1.0, 1.0, 0.0, 0.0)
    return Grid(dx, dy, a["least"], b["least"], round((a["most"] - a["least"]) / dx) + 1, round((b["most"] - b["least"]) / dy) + 1)


def _whole(c: Column) -> Column:
    return c.cast("long")


def block_id(grid: Grid, factor: int = 20, x: str = "x", y: str = "y") -> Column:
    return _whole(F.floor((F.col(x) - grid.x0) / (grid.dx * factor)) * ID_BASE + F.floor((F.col(y) - grid.y0) / (grid.dy * factor)))


def cell_index(grid: Grid, x: str = "x", y: str = "y") -> tuple[Column, Column]:
    """Column and row number; halves go to the even number."""
    return _whole(F.rint((F.col(x) - grid.x0) / grid.dx)), _whole(F.rint((F.col(y) - grid.y0) / grid.dy))


def pixel_id(grid: Grid, x: str = "x", y: str = "y") -> Column:
    ix, iy = cell_index(grid, x, y)
    return ix * ID_BASE + iy


def inside(grid: Grid, ix: Column, iy: Column) -> Column:
    return ix.between(0, grid.nx - 1) & iy.between(0, grid.ny - 1)


def block_key(grid: Grid, factor: int, x: str = "x", y: str = "y") -> Column:
    """The block as text "bx_by"; its order is that of texts."""
    bx, by = (F.floor((F.col(c) - o) / (d * factor)).cast("string") for c, o, d in ((x, grid.x0, grid.dx), (y, grid.y0, grid.dy)))
    return F.concat_ws("_", bx, by)


def quarter_degree(c: Column) -> Column:
    return F.rint(c * 4) / 4


def tenth(c: Column) -> Column:
    return F.bround(c, 1)


@dataclass(frozen=True)
class Albers:
    """Equal-area conic on the WGS 84 ellipsoid (Snyder 1987, equations 14-1 to 14-19)."""

    lat1: float = 25.0
    lat2: float = 47.0
    lat0: float = 0.0
    lon0: float = 105.0
    a: float = 6378137.0
    f: float = 1 / 298.257223563

    @property
    def constants(self) -> tuple[float, float, float, float, float]:
        e2 = self.f * (2 - self.f)
        e = math.sqrt(e2)
        m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)

        def q(p: float) -> float:
            s = math.sin(p)
            return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

        p1, p2, p0 = map(math.radians, (self.lat1, self.lat2, self.lat0))
        n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
        c = m(p1) ** 2 + n * q(p1)
        return e2, e, n, c, self.a * math.sqrt(c - n * q(p0)) / n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        e2, e, n, c, rho0 = self.constants
        s = F.sin(F.radians(lat))
        q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
        rho, theta = self.a * F.sqrt(c - n * q) / n, n * F.radians(lon - self.lon0)
        return rho * F.sin(theta), rho0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column, steps: int = 6) -> tuple[Column, Column]:
        """Longitude and latitude; the latitude by a fixed number of Newton steps."""
        e2, e, n, c, rho0 = self.constants
        rho = F.sqrt(x * x + (rho0 - y) * (rho0 - y))
        theta = F.atan2(x, F.lit(rho0) - y)
        q = (c - rho * rho * n * n / self.a**2) / n
        start = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / 2)))

        def step(p: Column, _: Column) -> Column:
            s = F.sin(p)
            w = 1 - e2 * s * s
            return p + w * w / (2 * F.cos(p)) * (q / (1 - e2) - s / w + F.log((1 - e * s) / (1 + e * s)) / (2 * e))

        p = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
        return self.lon0 + F.degrees(theta / n), F.degrees(p)
