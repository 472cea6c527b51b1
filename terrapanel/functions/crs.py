"""Coordinate systems from their texts, as pairs of column expressions to and from longitude and latitude.

``parsed`` reads EPSG codes (4326 and the UTM zones on WGS 84), PROJ strings and WKT 1 texts of geographic coordinates, Albers
equal-area conic, Lambert conformal conic and transverse Mercator (with UTM).  The formulas are Snyder's (1987) for
the conics and Krueger's series to the fourth order for transverse Mercator (well under a millimetre within a zone).  Datums are not shifted:
coordinates are taken on the ellipsoid that the text names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Albers

#: Semi-major axis and inverse flattening of ellipsoids.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "krass": (6378245.0, 298.3)}


@dataclass(frozen=True)
class Geographic:
    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon, lat

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return x, y


@dataclass(frozen=True)
class Shifted:
    """A projection with false easting and northing."""

    inner: Albers | Lambert
    east: float
    north: float

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        x, y = self.inner.forward(lon, lat)
        return x + self.east, y + self.north

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.inner.inverse(x - self.east, y - self.north)


@dataclass(frozen=True)
class Lambert:
    """Conformal conic with two standard parallels (Snyder, equations 15-7 to 15-11)."""

    lat1: float
    lat2: float
    lat0: float
    lon0: float
    a: float = ELLIPSOIDS["WGS84"][0]
    f: float = 1 / ELLIPSOIDS["WGS84"][1]
    k: float = 1.0

    @property
    def constants(self) -> tuple[float, float, float, float]:
        """e, cone constant, scale of rho, rho at lat0."""
        e = math.sqrt(self.f * (2 - self.f))
        m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
        t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
        p1, p2, p0 = map(math.radians, (self.lat1, self.lat2, self.lat0))
        n = math.sin(p1) if abs(p1 - p2) < 1e-12 else math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
        scale = self.a * self.k * m(p1) / (n * t(p1) ** n)
        return e, n, scale, scale * t(p0) ** n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        e, n, scale, rho0 = self.constants
        p = F.radians(lat)
        s = e * F.sin(p)
        rho = scale * F.pow(F.tan(math.pi / 4 - p / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2)), F.lit(n))
        theta = n * F.radians(lon - self.lon0)
        return rho * F.sin(theta), rho0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column, steps: int = 8) -> tuple[Column, Column]:
        e, n, scale, rho0 = self.constants
        side = math.copysign(1.0, n)
        t = F.pow(side * F.sqrt(x * x + (rho0 - y) * (rho0 - y)) / scale, F.lit(1 / n))

        def step(p: Column, _: Column) -> Column:
            s = e * F.sin(p)
            return math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(e / 2)))

        p = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), math.pi / 2 - 2 * F.atan(t), step)
        return self.lon0 + F.degrees(F.atan2(side * x, side * (F.lit(rho0) - y)) / n), F.degrees(p)


@dataclass(frozen=True)
class TransverseMercator:
    lat0: float
    lon0: float
    k: float = 1.0
    east: float = 0.0
    north: float = 0.0
    a: float = ELLIPSOIDS["WGS84"][0]
    f: float = 1 / ELLIPSOIDS["WGS84"][1]

    @property
    def third(self) -> float:
        return self.f / (2 - self.f)

    @property
    def radius(self) -> float:
        n = self.third
        return self.k * self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @property
    def series(self) -> tuple[list[float], list[float], list[float]]:
        """Coefficients of the forward, the inverse and the latitude series."""
        n = self.third
        alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
        return alpha, beta, delta

    @property
    def origin(self) -> float:
        """Northing of lat0 on the central meridian."""
        c, s = 2 * math.sqrt(self.third) / (1 + self.third), math.sin(math.radians(self.lat0))
        xi = math.atan(math.sinh(math.atanh(s) - c * math.atanh(c * s)))
        return self.radius * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(self.series[0], 1)))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        c, s, d = 2 * math.sqrt(self.third) / (1 + self.third), F.sin(F.radians(lat)), F.radians(lon - self.lon0)
        t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
        xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for j, a in enumerate(self.series[0], 1):
            x, y = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta), y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return self.east + self.radius * x, self.north - self.origin + self.radius * y

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        xi, eta = (y - self.north + self.origin) / self.radius, (x - self.east) / self.radius
        u, v = xi, eta
        for j, b in enumerate(self.series[1], 1):
            u, v = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta), v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)

        def latitude(chi: Column) -> Column:
            p = chi
            for j, d in enumerate(self.series[2], 1):
                p = p + d * F.sin(2 * j * chi)
            return F.degrees(p)

        # the conformal latitude is worked out once
        lat = F.element_at(F.transform(F.array(F.asin(F.sin(u) / F.cosh(v))), latitude), 1)
        return self.lon0 + F.degrees(F.atan2(F.sinh(v), F.cos(u))), lat


Projection = Geographic | Albers | Shifted | Lambert | TransverseMercator
#: Names of projections and parameters in WKT, as PROJ names them.
WKT_NAMES = {"albers": "aea", "albers_conic_equal_area": "aea", "lambert_conformal_conic": "lcc", "lambert_conformal_conic_2sp": "lcc", "lambert_conformal_conic_1sp": "lcc", "transverse_mercator": "tmerc", "gauss_kruger": "tmerc"}
WKT_PARAMETERS = {"standard_parallel_1": "lat_1", "standard_parallel_2": "lat_2", "latitude_of_origin": "lat_0", "latitude_of_center": "lat_0", "central_meridian": "lon_0", "longitude_of_center": "lon_0", "scale_factor": "k", "false_easting": "x_0", "false_northing": "y_0"}


def _built(kind: str, v: dict[str, float], a: float, f: float) -> Projection:
    if kind in ("longlat", "latlong"):
        return Geographic()
    if kind == "tmerc":
        return TransverseMercator(v.get("lat_0", 0.0), v.get("lon_0", 0.0), v.get("k", v.get("k_0", 1.0)), v.get("x_0", 0.0), v.get("y_0", 0.0), a, f)
    if kind not in ("aea", "lcc"):
        raise ValueError(f"no projection {kind}")
    lat1 = v.get("lat_1", v.get("lat_0", 0.0))
    lat2 = v.get("lat_2", lat1)
    inner = Albers(lat1, lat2, v.get("lat_0", 0.0), v.get("lon_0", 0.0), a, f) if kind == "aea" else Lambert(lat1, lat2, v.get("lat_0", lat1), v.get("lon_0", 0.0), a, f, v.get("k", v.get("k_0", 1.0)))
    return Shifted(inner, v.get("x_0", 0.0), v.get("y_0", 0.0)) if v.get("x_0") or v.get("y_0") else inner


def _utm(zone: int, south: bool) -> TransverseMercator:
    return TransverseMercator(0.0, 6.0 * zone - 183.0, 0.9996, 500_000.0, 10_000_000.0 if south else 0.0)


def parsed(text: str | None) -> Projection:
    """The projection of a text; no text at all counts as longitude and latitude."""
    text = (text or "EPSG:4326").strip()
    if m := re.fullmatch(r"(?i)(?:urn:ogc:def:crs:)?epsg:+(\d+)", text):
        code = int(m[1])
        if code == 4326:
            return Geographic()
        if 32601 <= code <= 32660 or 32701 <= code <= 32760:
            return _utm(code % 100, code > 32700)
        raise ValueError(f"no projection EPSG:{code}: name it by a PROJ string or WKT")
    if "+proj=" in text:
        given = dict(p.lstrip("+").split("=", 1) if "=" in p else (p.lstrip("+"), "1") for p in text.split())
        a, rf = ELLIPSOIDS[given.get("ellps", given.get("datum", "WGS84"))]
        a = float(given.get("a", a))
        f = 1 - float(given["b"]) / a if "b" in given else 1 / float(given.get("rf", rf))
        if given["proj"] == "utm":
            return _utm(int(given["zone"]), "south" in given)
        numbers = {k: float(v) for k, v in given.items() if re.fullmatch(r"[-+]?[\d.]+(?:[eE][-+]?\d+)?", v)}
        return _built(given["proj"], numbers, a, f)
    if m := re.search(r'SPHEROID\s*\[\s*"[^"]*"\s*,\s*([\d.]+)\s*,\s*([\d.]+)', text):
        a, f = float(m[1]), 1 / float(m[2]) if float(m[2]) else 0.0
        name = re.search(r'PROJECTION\s*\[\s*"([^"]+)"', text)
        if name is None:
            return Geographic()
        values = {WKT_PARAMETERS.get(k.lower(), k.lower()): float(v) for k, v in re.findall(r'PARAMETER\s*\[\s*"([^"]+)"\s*,\s*([-+\d.eE]+)', text)}
        return _built(WKT_NAMES.get(name[1].lower(), name[1]), values, a, f)
    raise ValueError(f"no coordinate system in {text!r}")


def converted(df: DataFrame, there: Projection, here: Projection, x: str = "x", y: str = "y", out: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Columns ``out``: the coordinates x and y of ``there`` as coordinates of ``here``.

    Longitude and latitude are columns of their own in between, so that their long expressions are worked out once.
    """
    if there == here:
        return df.withColumns(dict(zip(out, (F.col(x), F.col(y)), strict=True)))
    lon, lat = there.inverse(F.col(x), F.col(y))
    own = df.withColumns({"_lon": lon, "_lat": lat})
    return own.withColumns(dict(zip(out, here.forward(F.col("_lon"), F.col("_lat")), strict=True))).drop("_lon", "_lat")
