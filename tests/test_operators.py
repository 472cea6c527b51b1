"""Edge cases on small fixtures, and NumPy forms of what SQL cannot say."""

import inspect
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrapanel.functions import distributions as dist
from terrapanel.functions.grid import Albers, Grid, block_id, grid_of, pixel_id
from terrapanel.operators import boosted, bootstrap, climate, correlogram, crossfit, diagnostics, features, inference, kernel, multiplicity, quantiles, raster, trend, tuning
from terrapanel.operators.components import components
from terrapanel.operators.folds import Split, balanced_folds, chunk_folds, shuffled_folds
from terrapanel.sources import layers
from terrapanel.sources.panel import PanelSchema, complete_cases, duplicate_keys, month_number, read_components, read_layers, read_panel, require_unique
from terrapanel.sources.sinks import append_year, checkpointed, signature, write_csv, write_report, write_table


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double")
    assert [r.v for r in complete_cases(df, "v").collect()] == [1.0]


def test_month_texts(spark):
    df = spark.createDataFrame([("7",), ("2004-07",), ("abc",), ("13",), ("12.0",), (None,)], "m string")
    assert [r[0] for r in df.select(month_number(F.col("m"))).collect()] == [7, 7, None, None, 12, None]


def test_read_panel(spark, tmp_path):
    rows = [(0.0, 0.0, 2001, "2001-03", 1.0, 2.0, 10), (5.0, 0.0, 1999, "4", 1.0, float("nan"), 20)]
    spark.createDataFrame(rows, "x double, y double, year int, month string, SIF double, O3 double, LCCS int").write.option("header", True).csv(str(tmp_path / "p"))
    got = read_panel(spark, str(tmp_path / "p"), PanelSchema(("lccs", "dem")), "csv").collect()
    assert [(r.year, r.month, r.sif, r.lccs) for r in got] == [(2001, 3, 1.0, 10.0)]
    with pytest.raises(ValueError, match="dem"):
        read_panel(spark, str(tmp_path / "p"), PanelSchema(("lccs", "dem"), strict=True), "csv")


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(0.0, 0.0, 2000, 1)] * 2 + [(1.0, 0.0, 2000, 1)], "x double, y double, year int, month int")
    assert duplicate_keys(df).count() == 1
    with pytest.raises(ValueError):
        require_unique(df)


def test_half_cells_go_to_even(spark):
    g = Grid(2.0, 2.0, 0.0, 0.0)
    df = spark.createDataFrame([(1.0, 3.0), (5.0, 0.0)], "x double, y double")
    assert [r[0] for r in df.select(pixel_id(g)).collect()] == [2, 2 * 10_000_000]
    assert [r[0] for r in df.select(block_id(g, 2)).collect()] == [0, 10_000_000]


def test_grid_of_empty(spark):
    assert grid_of(spark.createDataFrame([], "x double, y double")).dx == 1.0


def test_albers_round_trip(spark):
    a = Albers()
    df = spark.createDataFrame([(73.5, 18.2), (105.0, 35.0), (134.9, 53.4)], "lon double, lat double")
    x, y = a.forward(F.col("lon"), F.col("lat"))
    lon, lat = a.inverse(F.col("x"), F.col("y"))
    for r in df.withColumn("x", x).withColumn("y", y).select("lon", "lat", "x", lon.alias("a"), lat.alias("b")).collect():
        assert abs(r.a - r.lon) < 1e-9 and abs(r.b - r.lat) < 1e-9
    assert abs(df.where("lon = 105").select(x.alias("x")).first().x) < 1e-6


@pytest.mark.parametrize("n", [5, 7, 12, 23])
def test_chunks_like_array_split(spark, n):
    df = spark.createDataFrame([(2000 + i,) for i in range(n)], "year int")
    sizes = [r["count"] for r in chunk_folds(df, "year").groupBy("tfold").count().orderBy("tfold").collect()]
    assert sizes == [len(c) for c in np.array_split(np.arange(n), 5)]


def test_balanced_folds(spark):
    df = spark.createDataFrame([(b,) for b in range(12) for _ in range(b + 1)], "block long")
    load = [r["count"] for r in df.join(balanced_folds(df, "block", 3), "block").groupBy("fold").count().collect()]
    assert max(load) - min(load) <= 12 and sum(load) == 78
    a, b = (shuffled_folds(df, "block", 3, seed=1).orderBy("block").collect() for _ in range(2))
    assert a == b and {r.fold for r in a} == {0, 1, 2}


def _rows(spark, n=400, k=3, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.normal(size=(n, k)), columns=[f"c{i}" for i in range(k)])
    pdf["o3"] = pdf["c0"] * 2 + rng.normal(size=n)
    pdf["sif"] = pdf["o3"] * 0.5 - pdf["c1"] + rng.normal(size=n)
    pdf["fold"], pdf["tfold"], pdf["block"], pdf["year"] = rng.integers(0, 5, n).astype(np.int32), rng.integers(0, 5, n).astype(np.int32), rng.integers(0, 20, n), rng.integers(2000, 2007, n).astype(np.int32)
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("kind", ["spatial", "both", "either"])
@pytest.mark.parametrize("k", [3, 12])
def test_residuals_like_least_squares(spark, kind, k):
    pdf, df = _rows(spark, k=k)
    controls = [f"c{i}" for i in range(k)]
    got = crossfit.oof_residuals(df.withColumn("id", F.col("c0")), "o3", "sif", controls, Split(kind)).toPandas()
    want = {}
    for s in range(5):
        for t in range(5) if kind == "both" else [s]:
            both = (pdf.fold != s) & (pdf.tfold != t)
            train, test = {"spatial": (pdf.fold != s, pdf.fold == s), "both": (both, (pdf.fold == s) & (pdf.tfold == t)), "either": (both, (pdf.fold == s) | (pdf.tfold == s))}[kind]
            x = np.column_stack([np.ones(len(pdf)), pdf[controls]])
            b = np.linalg.lstsq(x[train], pdf.loc[train, ["o3", "sif"]].to_numpy(), rcond=None)[0]
            for i in np.flatnonzero(test):
                want[pdf.c0[i], s] = pdf.loc[i, ["o3", "sif"]].to_numpy(float) - x[i] @ b
    assert len(got) == len(want)
    for r in got.itertuples():
        assert np.allclose([r.d, r.r], want[r.c0, r.test], atol=1e-8)


def test_singular_design_leaves_rows_out(spark):
    df = spark.createDataFrame([(1.0, float(i), float(i), i % 2) for i in range(10)], "c double, o3 double, sif double, fold int")
    assert crossfit.oof_residuals(df, "o3", "sif", ["c"], Split("spatial", 2)).count() == 0


def test_one_cluster_and_fallback(spark):
    comp = spark.createDataFrame([(1, 2000, 1.0, 2.0, 3), (1, 2001, 3.0, 2.0, 3)], "block long, year int, num double, den double, n long")
    r = inference.two_way(comp, [], "block", "year").first()
    assert r.g1 == 1 and r.g2 == 2 and math.isclose(r.theta, 1.0) and r.fallback and r.se > 0
    t = inference.with_t(inference.two_way(comp, [], "block", "year")).first()
    assert t.t_df == 1 and t.ci_t_low < t.effect < t.ci_t_high


def test_two_way_like_numpy(spark):
    pdf, df = _rows(spark)
    got = inference.two_way(components(df.withColumn("d", F.col("o3")).withColumn("r", F.col("sif")), ["block", "year"]), [], "block", "year", small=False).first()
    d, y = pdf.o3.to_numpy(), pdf.sif.to_numpy()
    theta = d @ y / (d @ d)
    s = pd.Series(d * (y - theta * d))
    m = [float((s.groupby([pdf[k] for k in keys]).sum() ** 2).sum()) for keys in (["block"], ["year"], ["block", "year"])]
    assert math.isclose(got.theta, theta) and math.isclose(got.se, math.sqrt(m[0] + m[1] - m[2]) / (d @ d), rel_tol=1e-9)


def test_joint_effects_like_numpy(spark):
    pdf, df = _rows(spark)
    got = {r.exposure: r for r in inference.joint_effects(df, ["o3", "c1"], "sif", "block", "year").collect()}
    b = np.linalg.lstsq(pdf[["o3", "c1"]].to_numpy(), pdf.sif.to_numpy(), rcond=None)[0]
    assert np.allclose([got["o3"].theta, got["c1"].theta], b) and got["o3"].se > 0


def _bh(p, by=False):
    q, ok = np.full(len(p), np.nan), np.flatnonzero(np.isfinite(p))
    order = ok[np.argsort(p[ok], kind="stable")]
    m = len(order)
    raw = p[order] * m / np.arange(1, m + 1) * (np.sum(1 / np.arange(1, m + 1)) if by else 1)
    q[order] = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
    return q


def test_fdr_and_holm(spark):
    p = np.array([0.01, 0.01, 0.02, 1.0, np.nan, 0.5, 0.0, 0.04, 0.04])
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(p)), "p": p}))
    for method in ("bh", "by"):
        got = multiplicity.fdr(df, "p", method=method).orderBy("i").toPandas()["q"].to_numpy(float)
        assert np.allclose(got, _bh(p, method == "by"), equal_nan=True)
    got = multiplicity.holm(df, "p").orderBy("i").toPandas()["p_holm"].to_numpy(float)
    assert np.allclose(got, multiplicity.holm_values(p), equal_nan=True)
    assert multiplicity.fdr(df.limit(0), "p").count() == 0


def test_distributions():
    assert np.allclose(dist.t_quantile(0.975, np.array([1, 5, 22])), [12.7062047, 2.5705818, 2.0738731])
    assert np.allclose(dist.t_sf2(np.array([2.0738730679]), np.array([22])), 0.05)
    assert np.allclose(dist.f_sf(np.array([3.0]), np.array([2]), np.array([10])), 0.0953674)
    assert math.isclose(dist.sign_test(3, 10), 0.34375) and math.isclose(dist.normal_quantile(0.975), 1.959963985, rel_tol=1e-8)


def test_future_join_does_not_bridge_gaps(spark):
    df = spark.createDataFrame([(1, 2000, 1, 1.0), (1, 2002, 1, 3.0), (1, 2003, 1, 4.0)], "pixel long, year int, month int, o3 double")
    assert [(r.year, r.o3_next) for r in features.future_exposure(df, "o3").collect()] == [(2002, 4.0)]


def test_classes_and_dummies(spark):
    df = spark.createDataFrame([(10.0,), (20.4,), (62.0,), (99.0,), (None,)], "lccs double")
    assert [r[0] for r in df.select(features.class_group(F.col("lccs"))).collect()] == [10, 10, 60, None, None]
    out, names = features.one_hot(df, "lccs")
    assert names == ["lccs_20", "lccs_62", "lccs_99"] and out.agg(F.sum("lccs_62")).first()[0] == 1.0


def test_kernel_like_dense(spark):
    rng = np.random.default_rng(3)
    a = np.where(rng.random((9, 7)) < 0.4, rng.random((9, 7)), 0)
    iy, ix = np.nonzero(a)
    df = spark.createDataFrame(pd.DataFrame({"m": 1, "ix": ix, "iy": iy, "v": a[iy, ix]}))
    grid, k = Grid(1000.0, 1000.0, 0, 0, 7, 9), dict(kernel.weights(1.0, 1000.0))
    got = kernel.smooth(df, ["v"], ["m"], grid, 1.0).toPandas()
    want = np.zeros_like(a)
    for y in range(9):
        for x in range(7):
            want[y, x] = sum(a[y + i, x + j] * k[i] * k[j] for i in k for j in k if 0 <= y + i < 9 and 0 <= x + j < 7)
    dense = np.zeros_like(a)
    dense[got.iy, got.ix] = got.v
    assert np.allclose(dense, want)


def test_trend_guards(spark):
    def t(y):
        got = trend.adjusted_trends(np.arange(len(y), dtype=float)[None], np.array([y], float))
        return {k: float(v[0]) for k, v in got.items()}

    assert math.isnan(t([1.0, 2.0])["mk_z"]) and math.isnan(t([5.0] * 6)["mk_p"])
    up = t([1, 2, 3, 4, 5, 6, 7, 8])
    assert up["sen_slope"] == 1 and up["mk_p"] < 0.01 and math.isclose(up["ols_r2"], 1.0)
    df = spark.createDataFrame([(1, 2000 + i, v) for i, v in enumerate([1.0, 1.0, 2.0, 0.5])] + [(2, 2000, 1.0)], "pixel long, year int, v double")
    mk = {r.pixel: r for r in trend.mann_kendall(df, "v").collect()}
    assert mk[1].mk_s == -1 and math.isclose(mk[1].mk_var, (4 * 3 * 13 - 18) / 18) and mk[2].mk_s is None
    assert trend.least_years(23) == 17 and trend.least_years(3) == 8


def one_trend(y):
    """z, p, factor and lag-1 rank correlation of one series, value by value."""
    n = len(y)
    slopes = sorted((y[j] - y[i]) / (j - i) for i in range(n) for j in range(i + 1, n))
    m = len(slopes)
    slope = (slopes[(m - 1) // 2] + slopes[m // 2]) / 2
    s = sum((y[j] > y[i]) - (y[j] < y[i]) for i in range(n) for j in range(i + 1, n))
    var = n * (n - 1) * (2 * n + 5) - sum(c * (c - 1) * (2 * c + 5) for c in (y.count(v) for v in set(y)))
    var /= 18
    rest = [round((v - slope * i) / max(map(abs, y)), 9) for i, v in enumerate(y)]
    ranks = [sum(b < a for b in rest) + (rest.count(a) + 1) / 2 for a in rest]
    total, first = 0.0, None
    for lag in range(1, n):
        a, b = ranks[:-lag], ranks[lag:]
        rho = float(np.corrcoef(a, b)[0, 1]) if len(a) >= 3 and len(set(a)) > 1 and len(set(b)) > 1 else 0.0
        first = rho if first is None else first
        if abs(rho) > 1.959963984540054 / math.sqrt(n):
            total += (n - lag) * (n - lag - 1) * (n - lag - 2) * rho
    factor = 1 + 2 * total / (n * (n - 1) * (n - 2))
    factor = factor if factor > 0 else 1.0
    z = 0.0 if s == 0 else (s - np.sign(s)) / math.sqrt(var * factor)
    return slope, z, math.erfc(abs(z) / math.sqrt(2)), factor, first


def test_adjusted_trends_of_autocorrelated_series(spark):
    rng = np.random.default_rng(12)
    series = []
    for k in range(40):
        n, phi = int(rng.integers(8, 24)), rng.choice([0.0, 0.6, 0.9, -0.5])
        v = [float(rng.normal())]
        for _ in range(n - 1):
            v.append(float(phi * v[-1] + rng.normal()))
        series.append([round(x + 0.05 * i * (k % 3), 1 if k % 4 == 0 else 6) for i, x in enumerate(v)])  # some with ties
    df = spark.createDataFrame([(k, 2000 + i, v) for k, y in enumerate(series) for i, v in enumerate(y)], "pixel long, year int, v double")
    got = {r.pixel: r for r in trend.trends(df, ["v"]).collect()}
    factors = set()
    for k, y in enumerate(series):
        slope, z, p, factor, lag1 = one_trend(y)
        factors.add(round(factor, 3))
        assert np.allclose([got[k].sen_slope, got[k].mk_z, got[k].mk_p, got[k].factor, got[k].lag1], [slope, z, p, factor, lag1], atol=1e-9), k
    assert len(factors) > 5  # the adjustment acts


def test_many_tests_at_once(spark):
    """Yekutieli's factor takes no longer with the number of tests."""
    df = spark.range(200_000).select(((F.col("id") * 7919 % 200_000 + 1) / 200_000.0).alias("p"))
    assert multiplicity.fdr(df, "p", method="by").where("q < 1").count() == 0
    m = spark.createDataFrame([(1,), (2,), (63,), (64,), (65,), (1000,), (10**6,)], "m long")
    for r in m.select("m", multiplicity.harmonic(F.col("m")).alias("h")).collect():
        assert math.isclose(r.h, math.fsum(1 / i for i in range(1, r.m + 1)), rel_tol=1e-13)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    values = {1: rng.normal(size=5000), 2: np.repeat([3.0, 5.0], [70, 30]), 3: np.array([4.0]), 4: np.exp(8 * rng.normal(size=300))}
    df = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [(1, None), (5, None)], "k long, v double")
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        got = {r.k: r.q for r in quantiles.quantile(df, ["k"], "v", q, "q").collect()}
        assert got.keys() == values.keys() and all(math.isclose(got[k], float(np.quantile(v, q)), rel_tol=1e-12) for k, v in values.items())


def test_resampling_like_numpy(spark):
    """wild_year draw by draw."""
    num, den = [1.0, 2.5, -0.5, 3.0], [2.0, 1.0, 1.5, 2.5]
    comp = spark.createDataFrame([(2000 + i, 1, 1, a, b, 1) for i, (a, b) in enumerate(zip(num, den, strict=True))], "year int, block int, k int, num double, den double, n long")
    got = bootstrap.wild_year(comp, ["k"], reps=500).first()
    theta, factor = sum(num) / sum(den), 4 / 3
    draws = bootstrap.draws(bootstrap.SEED, (1,), range(500), [2000, 2001, 2002, 2003]).tolist()
    size = lambda v: sum(v) / math.sqrt(factor * sum(x * x for x in v))
    beyond = sum(abs(size([w * x for w, x in zip(d, num, strict=True)])) >= abs(size(num)) for d in draws)
    shift = [sum(w * (x - theta * y) for w, x, y in zip(d, num, den, strict=True)) / sum(den) for d in draws]
    low, high = np.quantile(shift, [0.025, 0.975])
    assert math.isclose(got.theta, theta) and math.isclose(got.p_wild, (1 + beyond) / 501) and np.allclose([got.ci_low, got.ci_high], [theta - high, theta - low])
    one, two = (bootstrap.draws(1, (2000, k), range(600), [1, 2]) for k in (1, 2))
    assert (one != two).any() and set(np.unique(one).round(6)) == set(bootstrap.WEBB.round(6))


def test_unidentified_effects(spark):
    rows = spark.createDataFrame([(float(i), 2.0 * i, float(i % 3), i % 4, i % 5) for i in range(40)], "d double, e double, r double, block int, year int")
    assert all(r.theta is None or math.isnan(r.theta) for r in inference.joint_effects(rows, ["d", "e"], "r", "block", "year").collect())
    with pytest.raises(ValueError, match="variation"):
        inference.paired_contrast(rows.limit(0), ("d", "r"), ("e", "r"), "block", "year")


def test_checked_joins_and_order(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 7, "a"), (2, 1, "z")], "k int, t int, name string")
    assert [tuple(r) for r in features.latest(df, ["k"], F.col("t")).orderBy("k").collect()] == [(1, 7, "a"), (2, 1, "z")]
    assert [r.name for r in features.in_order(df, "name", ["z", "a"]).collect()] == ["z", "a", "b"]
    assert features.joined_once(df, df.where("k = 2").select("k", F.lit(9).alias("v")), ["k"]).count() == 3
    for bad in (lambda: features.joined_once(df, df.select("k", "t"), ["k"]), lambda: features.looked_up(df, "name", {"a": 1, "b": 2}, "v")):
        with pytest.raises(Exception, match="more than one row|without an entry"):
            bad().collect()


def test_grids_and_rings(spark, tmp_path):
    (tmp_path / "g").mkdir()
    head = "ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9999\n"
    (tmp_path / "g" / "sif_200106.asc").write_text(head + "1 2 3\n4 -9999 6\n")
    (tmp_path / "g" / "o3_2003032.asc").write_text(head + "1 2 3\n4 5 6\n")
    got = sorted((r.file_name[:2], r.year, r.month, r.ix, r.iy, r.x, r.y, r.value) for r in layers.read_grids(spark, str(tmp_path / "g")).collect())
    assert len(got) == 11 and got[0] == ("o3", 2003, 2, 0, 0, 11.0, 21.0, 4.0) and ("si", 2001, 6, 1, 1, 13.0, 23.0, 2.0) in got
    with pytest.raises(ValueError, match="values"):
        layers.decoded((head + "1 2\n").encode())
    shapes = spark.createDataFrame([("MULTIPOLYGON (((0 0, 4 0, 4 4, 0 0)), ((9 9, 10 9, 9 10, 9 9)))",), ("POLYGON((1 1,2 1,1 2,1 1))",), (None,)], "wkt string")
    rings = layers.vertices(shapes).groupBy("ring_id").agg(F.count("*").alias("n"), F.max("x").alias("x")).collect()
    assert sorted((r.n, r.x) for r in rings) == [(3, 2.0), (3, 4.0), (3, 10.0)]


def test_components_layers_and_reports(spark, tmp_path):
    part = spark.createDataFrame([(2001, 1, 5, 7, 1.0, 2.0, 3.0, 4.0, 9)], "year int, month int, pixel_id long, block long, x double, y double, numerator_raw double, denominator_raw double, n_obs long")
    part.write.parquet(str(tmp_path / "c"))
    assert read_components(spark, str(tmp_path / "c")).first().spatial_block == 7
    with pytest.raises(ValueError, match="t2m"):
        read_components(spark, str(tmp_path / "c"), ("year", "t2m"))
    assert read_layers(spark, str(tmp_path / "c")).first().file_name.endswith(".parquet")
    write_report(spark, str(tmp_path / "r"), {"Effects": part.select("year", "x"), "None": part.limit(0).select("year")})
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r")).collect())
    assert "Effects\n-------\nyear | x\n2001 | 1" in text and "None" in text


def test_projection_of_layers(spark):
    a, df = Albers(), spark.createDataFrame([(105.0, 30.0)], "x double, y double")
    once = raster.reprojected(df, a)
    assert once.first().crs == "albers" and abs(once.first().x) < 1e-6 and raster.reprojected(once, a).first() == once.first()
    with pytest.raises(Exception, match="no projection"):
        raster.reprojected(df.withColumn("crs", F.lit("EPSG:1")), a).collect()


def test_mode_ties_and_masks(spark):
    df = spark.createDataFrame([(0, 0, 5.0), (1, 1, 3.0), (0, 1, None), (2, 0, -1.0)], "ix long, iy long, value double")
    assert {(r.ix, r.iy, r.value) for r in raster.mode_resample(df, 2).collect()} == {(0, 0, 3.0), (1, 0, -1.0)}
    assert raster.masked(df).where("value is null").count() == 2


def test_polygon_touches_without_centre(spark):
    cells = spark.createDataFrame([(i, j, float(i), float(j)) for i in range(4) for j in range(4)], "ix long, iy long, x double, y double")
    ring = spark.createDataFrame([(1, 0, 0.9, 0.9), (1, 1, 1.6, 0.9), (1, 2, 1.6, 1.1), (1, 3, 0.9, 1.1)], "ring_id int, seq int, x double, y double")
    assert {(r.ix, r.iy) for r in raster.clipped(cells, ring, 1.0, 1.0).collect()} == {(1, 1), (2, 1)}


def test_tiled_pairs_like_all_pairs(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(120), "x": rng.random(120) * 100, "y": rng.random(120) * 100, "k": 1})
    got = {(r.a, r.b) for r in correlogram.pairs(spark.createDataFrame(pdf), 17.0, ["k"]).collect()}
    assert got == {(i, j) for i in range(120) for j in range(i + 1, 120) if math.hypot(pdf.x[i] - pdf.x[j], pdf.y[i] - pdf.y[j]) <= 17}


def test_wild_bootstraps_are_seeded(spark):
    comp = spark.createDataFrame([(b, y, m, float(np.sin(b * y + m)), 1.0 + m, 1) for b in range(6) for y in (2000, 2001, 2002) for m in range(1, 13)], "block long, year int, month int, num double, den double, n long")
    a, b = (bootstrap.wild_month(comp, ["year"], reps=199).orderBy("year").collect() for _ in range(2))
    assert a == b and all(0 < r.p_wild <= 1 for r in a)
    assert 0 < bootstrap.wild_year(comp, reps=199).first().p_wild <= 1


def test_candidates_are_seeded():
    assert tuning.candidates(3, 1) == tuning.candidates(3, 1) != tuning.candidates(3, 2)
    drawn = tuning.candidates(10)
    assert sorted(int((c["minInfoGain"]) // 0.5) for c in drawn) == list(range(10))  # every part of a range once
    assert all(300 <= c["maxIter"] <= 1200 and 3 <= c["maxDepth"] <= 10 and 0.01 <= c["stepSize"] <= 0.15 for c in drawn)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2000, 1.0), (2001, 2.0)], "year int, v double")
    write_table(df, str(tmp_path / "t"), "year")
    append_year(df.where("year = 2001").withColumn("v", F.lit(5.0)), str(tmp_path / "t"))
    assert {(r.year, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(2000, 1.0), (2001, 5.0)}
    write_csv(df, str(tmp_path / "c"), "gzip")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    for config, want in (({"a": 1}, 3.0), ({"a": 1}, 3.0), ({"a": 2}, 7.0)):
        made = checkpointed(df.agg(F.sum("v").alias("v") if want == 3.0 else F.lit(7.0).alias("v")), str(tmp_path / "k"), config)
        assert made.first().v == want
    assert signature({"a": 1, "b": 2}) == signature({"b": 2, "a": 1})


def test_boosted_residuals_cover_all_rows(spark, sf01, monkeypatch):
    from terrapanel.plans import effects, panels

    monkeypatch.setattr(boosted, "SETTING", boosted.SETTING | {"trees": 1, "depth": 2})
    rows = panels.supplier_rows(spark, sf01).cache()
    want = {r["fold"]: r["count"] for r in rows.dropna(subset=["o3", "sif", "t2m", "ssrd"]).groupBy("fold").count().collect()}
    got = effects.gbt_residuals(spark, sf01).collect()
    assert {(r.fold, r.stage): r.n for r in got} == {(f, s): n for f, n in want.items() for s in ("exposure", "outcome")}
    assert len(want) == panels.FOLDS
    with pytest.raises(ValueError, match="no test cell"):
        crossfit.gbt_residuals(rows, "o3", "sif", ["t2m"], Split("spatial", 2), trees=1, depth=1)


def test_registered_resampling_takes_production_counts(spark, monkeypatch):
    from terrapanel.operators import climate
    from terrapanel.plans import effects

    asked = []
    for name in ("yearly_components", "class_components", "climate_components"):
        monkeypatch.setattr(effects, name, lambda *a: None)
    monkeypatch.setattr(effects, "rounded", lambda df: df)
    for module, name in ((bootstrap, "wild_month"), (bootstrap, "wild_year"), (climate, "modifier")):
        default = inspect.signature(getattr(module, name)).parameters["reps"].default
        monkeypatch.setattr(module, name, lambda *a, reps=default, **k: asked.append(reps) or [(1,)])
    for query in (effects.wild_month, effects.wild_year, effects.wild_year_by_class, effects.climate_modifier):
        query(spark, "")
    assert asked == [9999, 9999, 9999, 4999]


def test_heterogeneity_like_numpy(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame([(s, b, y, float(rng.normal(0.3 * s, 1)), float(rng.uniform(1, 3))) for s in range(4) for b in range(9) for y in range(2000, 2006)], columns=["s", "block", "year", "num", "den"]).assign(n=1)
    test, pairs = inference.heterogeneity(spark.createDataFrame(pdf), "s")
    theta = (pdf.groupby("s").num.sum() / pdf.groupby("s").den.sum()).to_numpy()
    total = pdf.groupby("s").den.sum().to_numpy()
    v = (pdf.num - theta[pdf.s] * pdf.den) / total[pdf.s]
    cov = np.zeros((4, 4))
    for keys, sign in ((["block"], 1), (["year"], 1), (["block", "year"], -1)):
        score = v.groupby([pdf.s, *(pdf[k] for k in keys)]).sum().unstack(0).to_numpy()
        cov += sign * score.T @ score * len(score) / (len(score) - 1)
    values, vectors = np.linalg.eigh(cov)
    cov = vectors @ np.diag(values.clip(0)) @ vectors.T
    contrast = np.array([[-1, 1, 0, 0], [-1, 0, 1, 0], [-1, 0, 0, 1]], float)
    diff = contrast @ theta
    assert math.isclose(test["f"], diff @ np.linalg.pinv(contrast @ cov @ contrast.T) @ diff / 3, rel_tol=1e-8) and (test["df1"], test["df2"]) == (3, 5)
    p = []
    for r in pairs.itertuples(index=False):
        se = math.sqrt(cov[r.first, r.first] + cov[r.second, r.second] - 2 * cov[r.first, r.second])
        assert math.isclose(r.difference, theta[r.second] - theta[r.first], rel_tol=1e-9) and math.isclose(r.se, se, rel_tol=1e-8)
        p.append(float(dist.t_sf2(np.array([r.difference / se]), np.array([5]))[0]))
    assert np.allclose(pairs["p_t"], p) and np.allclose(pairs["p_holm"], multiplicity.holm_values(np.array(p)))


def test_climate_direction():
    fit = climate.Fit([4], np.array([1.0, -0.5]), {k: np.diag([0.1, 0.01]) for k in ("two_way", "year", "block")}, {"two_way": 9, "year": 9, "block": 9}, "two_way", np.zeros((10, 2)), np.eye(2))
    rows = lambda p: pd.DataFrame({"p_multiplier": [np.nan, p]})
    assert climate.direction(rows(0.01), fit) == "negative" and climate.direction(rows(0.2), fit) == "unclear"
    assert climate.direction(rows(0.01), fit._replace(beta=np.array([1.0, 0.1]))) == "unclear" and climate.direction(rows(0.01), fit._replace(beta=np.array([1.0, 0.5]))) == "positive"


@pytest.mark.parametrize("name", ["bucketed_match", "kernel_effect_map", "kernel_support_mask", "layer_match_join", "residual_support_by_year"])
def test_line_items_are_aggregated_once(spark, sf001, monkeypatch, name):
    """The panel behind queries that read it several times is made once: the result's plan reads no table of line items."""
    from terrapanel.plans import catalogue, panels

    made = []
    for panel in ("grid_panel", "supplier_panel"):
        own = getattr(panels, panel)
        monkeypatch.setattr(panels, panel, lambda *a, own=own: made.append(1) or own(*a))
    files = catalogue.QUERIES[name](spark, sf001).inputFiles()
    assert len(made) == 1 and not any("lineitem" in f for f in files)


def test_residual_support_does_not_depend_on_order(spark):
    rng = np.random.default_rng(12)
    base = np.concatenate([rng.normal(0, 3e4, 2000), [1.5e5, -1.6e5]])
    d = (base[:, None] * (1 + np.arange(-20, 20)[None] * 1e-16)).ravel()  # copies that differ by rounding
    rows = spark.createDataFrame(pd.DataFrame({"year": 2000, "d": d[rng.permutation(len(d))]}))
    got = [diagnostics.residual_support(rows.repartition(p), ["year"]).first() for p in (1, 7)]
    den = math.fsum(d * d)
    order = np.sort(np.abs(base))[::-1]
    for r in got:
        assert abs(r.den - den) <= 2 * np.spacing(den) and r.n == len(d)
        for share, q in ((r.top5_share, 0.95), (r.top1_share, 0.99)):
            cut = np.quantile(np.abs(d), q) * (1 - 1e-12)
            assert share == pytest.approx((order[order >= cut] ** 2).sum() * 40 / den, rel=1e-9)


def test_month_resampling_holds_no_blocks(spark):
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame([(2000, b, m, float(rng.normal()), float(rng.uniform(1, 2))) for b in range(300) for m in range(1, 13) if rng.random() < 0.8], columns=["year", "block", "month", "num", "den"]).assign(n=1)
    comp = spark.createDataFrame(pdf)
    sums = bootstrap.month_products(bootstrap.merged(comp, ["year", "block", "month"]), ["year"], "block", "month")
    assert sums.count() == 12 * 13 // 2  # whatever the number of blocks
    got = bootstrap.wild_month(comp, ["year"], reps=99).first()
    num, den = (pdf.pivot_table(index="block", columns="month", values=c, fill_value=0.0).to_numpy() for c in ("num", "den"))
    total, theta, g = den.sum(), num.sum() / den.sum(), (len(num), 12, int((den > 0).sum()))

    def error(cells):
        m1, m2, m12 = ((x**2).sum() * k / (k - 1) for x, k in zip((cells.sum(1), cells.sum(0), cells[den > 0]), g, strict=True))
        return math.sqrt(m1 + m2 - m12 if m1 + m2 - m12 > 0 else max(m1, m2)) / total

    t = []
    for w in bootstrap.draws(bootstrap.SEED, (2000,), range(99), list(range(1, 13))):
        cells = (num - theta * den) * w
        shift = cells.sum() / total
        t.append(abs(shift / error(cells - shift * den)))
    se = error(num - theta * den)
    assert (got.g1, got.g2) == g[:2] and got.theta == pytest.approx(theta) and got.se == pytest.approx(se)
    assert got.critical == pytest.approx(np.quantile(t, 0.95)) and got.p_wild == pytest.approx((1 + sum(x >= abs(theta / se) for x in t)) / 100)


def test_response_curves_read_kept_components(spark, sf001, monkeypatch):
    from terrapanel.plans import tables

    own, seen = climate.response_curves, []
    monkeypatch.setattr(climate, "response_curves", lambda rows, fit: seen.append(rows.inputFiles()) or own(rows, fit))
    assert tables.climate_response_curves(spark, sf001).count() > 0
    assert seen[0] and not any("panel" in f or "lineitem" in f for f in seen[0])
