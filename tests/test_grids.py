"""Kernel tiles, coordinate systems, warps, bucketed layers and footers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrapanel.functions import crs
from terrapanel.functions.grid import Albers, Grid
from terrapanel.operators import kernel, raster
from terrapanel.sources.panel import extents


@pytest.mark.parametrize("bandwidth", [1.0, 3.3])
def test_tiles_like_one_convolution(spark, monkeypatch, bandwidth):
    """Several tiles a month, halos across them, a last tile that is narrower, repeated cells and NULL values."""
    monkeypatch.setattr(kernel, "TILE", 8)
    rng, grid = np.random.default_rng(3), Grid(1000.0, 2000.0, 0.0, 0.0, 37, 29)
    d = pd.DataFrame({"m": rng.integers(1, 3, 300), "ix": rng.integers(-1, 38, 300), "iy": rng.integers(0, 29, 300), "v": rng.normal(size=300)})
    rows = spark.createDataFrame(d).union(spark.createDataFrame([(1, 5, 5, None)], "m long, ix long, iy long, v double"))
    got = kernel.smooth(rows, ["v"], ["m"], grid, bandwidth, squared=["v"]).toPandas()
    for m in (1, 2):
        a, here = np.zeros((37, 29)), np.zeros((37, 29), bool)
        own = d[(d.m == m) & d.ix.between(0, 36)]
        np.add.at(a, (own.ix, own.iy), own.v)
        here[own.ix, own.iy] = True
        here[5, 5] |= m == 1
        kx, ky = (kernel.weights(bandwidth, s) for s in (1000.0, 2000.0))
        want, squares, met = np.zeros_like(a), np.zeros_like(a), np.zeros_like(here)
        for i in range(37):
            for j in range(29):
                for u, wu in kx:
                    for v, wv in ky:
                        if 0 <= i + u < 37 and 0 <= j + v < 29:
                            want[i, j] += wu * wv * a[i + u, j + v]
                            squares[i, j] += (wu * wv) ** 2 * a[i + u, j + v]
                            met[i, j] |= here[i + u, j + v]
        g = got[got.m == m]
        assert {(r.ix, r.iy) for r in g.itertuples()} == set(zip(*np.nonzero(met), strict=True)) and not g.duplicated(["ix", "iy"]).any()
        assert np.allclose(g.v, want[g.ix, g.iy], atol=1e-12) and np.allclose(g.v2, squares[g.ix, g.iy], atol=1e-12)


def test_the_shuffle_does_not_grow_with_the_bandwidth(spark):
    grid = Grid(1000.0, 1000.0, 0.0, 0.0, 2000, 2000)
    rows = spark.range(20_000).select(F.lit(1).alias("m"), (F.col("id") * 7919 % 2000).alias("ix"), (F.col("id") * 104729 % 2000).alias("iy"), F.lit(1.0).alias("v"))
    sent = []
    for bandwidth in (10.0, 60.0):
        x = kernel.weights(bandwidth, 1000.0)[-1][0]
        t = max(kernel.TILE, 4 * x)
        reach = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - x) / t)), F.least(F.lit(1999 // t), F.floor((F.col(c) + x) / t)))  # noqa: E731, B023
        sent.append(rows.select(F.sum(F.size(reach("ix")) * F.size(reach("iy")))).first()[0] / 20_000)
    assert max(sent) < 2.6


# Snyder (1987), numerical examples on the Clarke 1866 ellipsoid
CLARKE = "+a=6378206.4 +b=6356583.8"
EXAMPLES = [
    ("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96", -75.0, 35.0, 1885472.7, 1535925.0),
    ("+proj=lcc +lat_1=33 +lat_2=45 +lat_0=23 +lon_0=-96", -75.0, 35.0, 1894410.9, 1564649.5),
    ("+proj=tmerc +lat_0=0 +lon_0=-75 +k=0.9996", -73.5, 40.5, 127106.5, 4484124.4),
]


@pytest.mark.parametrize(("text", "lon", "lat", "x", "y"), EXAMPLES)
def test_published_examples(spark, text, lon, lat, x, y):
    p, df = crs.parsed(f"{text} {CLARKE}"), spark.createDataFrame([(lon, lat)], "x double, y double")
    there = crs.converted(df, crs.Geographic(), p)
    assert np.allclose(there.first(), (x, y), atol=0.06)
    assert np.allclose(crs.converted(there, p, crs.Geographic()).first(), (lon, lat), atol=1e-9)


def test_texts_of_coordinate_systems():
    wkt = 'PROJCS["a",GEOGCS["g",DATUM["d",SPHEROID["WGS 84",6378137,298.257223563]]],PROJECTION["{}"],PARAMETER["standard_parallel_1",25],PARAMETER["standard_parallel_2",47],PARAMETER["central_meridian",105],PARAMETER["latitude_of_center",0],PARAMETER["false_easting",{}],UNIT["metre",1]]'
    assert crs.parsed(wkt.format("Albers_Conic_Equal_Area", 0)) == Albers(25.0, 47.0, 0.0, 105.0)
    assert crs.parsed(wkt.format("Albers", 7)) == crs.Shifted(Albers(25.0, 47.0, 0.0, 105.0), 7.0, 0.0)
    assert crs.parsed(wkt.format("Lambert_Conformal_Conic_2SP", 0)) == crs.Lambert(25.0, 47.0, 0.0, 105.0)
    assert crs.parsed(wkt.split(",PROJECTION")[0][14:]) == crs.parsed(None) == crs.parsed("epsg:4326") == crs.parsed("+proj=longlat +datum=WGS84") == crs.Geographic()
    assert crs.parsed("EPSG:32748") == crs.parsed("+proj=utm +zone=48 +south") and crs.parsed("EPSG:32748").north == 10_000_000
    for text in ("EPSG:4479", "+proj=moll", "nonsense", wkt.format("Mollweide", 0)):
        with pytest.raises(ValueError):
            crs.parsed(text)


def test_warp_leaves_no_gaps(spark):
    """A finer template gets every source cell several times; outside the source there is nothing."""
    source = spark.createDataFrame([(i, j, t, float(i * 10 + j)) for i in range(4) for j in range(4) for t in (1, 2)], "ix long, iy long, t int, value double")
    template = spark.createDataFrame([(i, j, 104.0 + i * 0.25, 30.0 + j * 0.25) for i in range(20) for j in range(20)], "ix long, iy long, x double, y double")
    got = raster.warped(source, Grid(1.0, 1.0, 104.0, 30.0, 4, 4), "EPSG:4326", template, None).collect()
    inside = {(i, j) for i in range(20) for j in range(20) if round(i / 4) < 4 and round(j / 4) < 4}
    assert {(r.ix, r.iy) for r in got} == inside and len(got) == 2 * len(inside)
    assert all(r.value == round(r.ix / 4) * 10 + round(r.iy / 4) for r in got)  # halves go to the even cell
    utm = crs.parsed("EPSG:32648")
    away = crs.converted(template, crs.Geographic(), utm)
    back = raster.warped(source, Grid(1.0, 1.0, 104.0, 30.0, 4, 4), None, away, "EPSG:32648").where("t = 1 and ix % 4 <> 2 and iy % 4 <> 2").collect()
    assert len(back) > 100 and all(r.value == round(r.ix / 4) * 10 + round(r.iy / 4) for r in back)


def test_bucketed_layers_meet_without_a_shuffle(spark):
    p = spark.range(4000).select((F.col("id") % 20).alias("ix"), (F.col("id") % 13).alias("iy"), (F.col("id") % 3).cast("int").alias("year"), F.col("id").alias("value")).dropDuplicates(["ix", "iy", "year"])
    static = p.groupBy("ix", "iy").agg(F.max("value").alias("value"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = raster.bucketed_layers({"base": (p.withColumnRenamed("value", "base"), []), "a": (p, ["ix", "iy", "year"]), "b": (static, ["ix", "iy"])}, 4)
        out = raster.match_layers(kept.pop("base")[0], kept)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.where("base = a and b >= a").count() == p.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_extents_from_footers(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") / 8).alias("x"))
    df.repartition(5).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    assert extents(spark, str(tmp_path / "t"), ["k", "x"]) == {"k": (0, 999), "x": (0.0, 999 / 8), "*": (1000,)}
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    assert not math.isnan(extents(spark, str(tmp_path / "t"), ["x"])["x"][1])
