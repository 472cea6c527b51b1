"""Queries about the panel itself: building, ids, folds, support, multiplicity, kernel maps, distance, trends, rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import parsed
from ..functions.grid import Albers, Grid, axis_info, block_id, block_key, pixel_id, quarter_degree, tenth
from ..operators import correlogram, crossfit, diagnostics, features, kernel, multiplicity, raster, trend
from ..operators.components import components
from ..operators.folds import Split, balanced_folds, chunk_folds, dense_folds, shuffled_folds
from ..sources import netcdf, tiff
from ..sources.files import put
from ..sources.layers import read_shapes, shapefile
from ..sources.panel import complete_cases, duplicate_keys, extents, month_number
from ..sources.sinks import scratch
from . import panels
from .panels import STEP, components_sql, grid_panel, grid_rows, grid_sql, kept_grid, oof_sql, rounded, supplier_panel, supplier_rows, supplier_sql
from .tails import normal_p_sql, q_sql, ranked_sql

GRID = Grid(STEP, STEP, 0.0, 0.0)


def panel_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = features.time_features(supplier_panel(spark, sf_dir))
    return rounded(p.select("pixel", "x", "y", "year", "month", "sif", "o3", "t2m", "ssrd", "tp", "lccs", "n_rows", "time_index", pixel_id(GRID).alias("pixel_code"), "month_02"), 9)


def panel_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(supplier_panel(spark, sf_dir)).agg(F.count("*").alias("n_duplicates"))


def null_normalise_complete_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = supplier_panel(spark, sf_dir)
    odd = p.withColumn("tp", F.when(F.col("pixel") % 7 == 0, F.lit(float("nan"))).when(F.col("pixel") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("tp")))
    return rounded(complete_cases(odd, "tp", "t2m").groupBy("year").agg(F.count("*").alias("n"), F.avg("tp").alias("tp_mean")))


def month_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("pixel") % 3 == 0, F.col("month").cast("string")).when(F.col("pixel") % 3 == 1, F.concat_ws("-", "year", F.lpad(F.col("month").cast("string"), 2, "0"))).otherwise(F.lit("none"))
    return supplier_panel(spark, sf_dir).withColumn("text", t).groupBy(month_number(F.col("text")).alias("parsed")).agg(F.count("*").alias("n"))


def grid_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = grid_panel(spark, sf_dir)
    return axis_info(p, "x").withColumn("axis", F.lit("x")).unionByName(axis_info(p, "y").withColumn("axis", F.lit("y")))


def block_ids_by_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = supplier_panel(spark, sf_dir).select("pixel", "x", "y").distinct()
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("factor"), block_id(GRID, k).alias("block"), block_key(GRID, k).alias("key")) for k in (1, 2, 4)))).alias("b")
    return p.select("pixel", each).select("pixel", "b.*")


def class_group_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_panel(spark, sf_dir).groupBy("lccs", features.class_group(F.col("lccs")).alias("class")).agg(F.count("*").alias("n"))


def class_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = features.one_hot(supplier_panel(spark, sf_dir), "lccs", list(panels.CODES))
    return df.groupBy("year").agg(*(F.sum(c).alias(c) for c in names))


def subclass_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = features.subclass_dummies(supplier_panel(spark, sf_dir).where(features.class_group(F.col("lccs")) == 10), "lccs", 10)
    return df.groupBy("year").agg(*(F.sum(c).alias(c) for c in names))


def year_month_sample_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = supplier_panel(spark, sf_dir).groupBy("year", "month").agg(F.count("*").alias("n"), F.count_distinct("pixel").alias("pixels"), *(a for v in ("sif", "o3") for a in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd"))))
    return rounded(out)


def month_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_panel(spark, sf_dir).groupBy(features.month_label(F.col("month")).alias("label")).agg(F.count("*").alias("n"))


def class_sample_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.summary(supplier_panel(spark, sf_dir), ["lccs"], ["sif"], ["pixel", "year"]))


def cell_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.eligibility(supplier_rows(spark, sf_dir), ["year", "month"], rows=90, blocks=5, folds=5)


def folds_time_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_folds(supplier_panel(spark, sf_dir), "year")


def folds_lexi_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_folds(supplier_panel(spark, sf_dir).withColumn("key", block_key(GRID, 2)), "key")


def folds_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_rows(spark, sf_dir).drop("fold")
    return balanced_folds(rows, "block")


def folds_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_rows(spark, sf_dir).drop("fold")
    return shuffled_folds(rows, "block")


def split_2d_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Split("both").sizes(supplier_rows(spark, sf_dir))


def split_or_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Split("either").sizes(supplier_rows(spark, sf_dir))


def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A p value a customer, with ties and NULLs, as a function of the key."""
    c = panels.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return c.withColumn("p", F.when(F.col("c_custkey") % 17 != 0, F.pow((F.col("c_custkey") * 7919 % 1000 + 1) / 1000.0, F.lit(3.0))))


_P = "p AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 17 <> 0 THEN pow((c_custkey * 7919 % 1000 + 1) / 1000.0, 3.0) END AS p FROM customer)"


def adjust_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(multiplicity.fdr(_p_values(spark, sf_dir), "p").select("c_custkey", "q"), 9)


def adjust_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(multiplicity.fdr(_p_values(spark, sf_dir), "p", method="by").select("c_custkey", "q"), 9)


def adjust_bh_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(multiplicity.fdr(_p_values(spark, sf_dir), "p", ["c_mktsegment"]).select("c_custkey", "q"), 9)


def adjust_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(multiplicity.holm(_p_values(spark, sf_dir), "p", ["c_mktsegment"]).select("c_custkey", "p_holm"), 9)


def grid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crossfit.oof_residuals(grid_rows(spark, sf_dir), "o3", "sif", ["t2m"], strata=["year"])
    return components(rows, ["ix", "iy", "year", "month"])


_KGRID, _BW = Grid(STEP, STEP, 0.0, 0.0, 25, 51), 10.0


def kernel_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid_panel(spark, sf_dir).groupBy("month", "ix", "iy").agg(F.sum("n_rows").cast("double").alias("v"))
    return rounded(kernel.smooth(cells, ["v"], ["month"], _KGRID, _BW))


def kernel_effect_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kernel.effect_map(grid_components(spark, sf_dir), _KGRID, _BW)
    return rounded(out, 4, effective_pixels=5)


def kernel_support_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask and summary by month; limits scaled to the years there are."""
    masked = kernel.support_mask(kernel.effect_map(grid_components(spark, sf_dir), _KGRID, _BW), years=3, mean_years=1.5, pixels=10.0)
    return rounded(kernel.map_summary(masked), 5)


def distance_correlogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_correlogram(spark, sf_dir), 5)


def _correlogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = grid_panel(spark, sf_dir).select(F.col("pixel").alias("id"), "x", "y", "year", "month", "o3", "sif")
    by_cell = correlogram.correlogram(points, ["o3", "sif"], bins_km=(0, 5.5, 10.5, 15))
    return correlogram.pooled_correlogram(by_cell, (0, 5.5, 10.5, 15))


def distance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(correlogram.dependence_summary(_correlogram(spark, sf_dir), 10.0), 5)


def distance_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator: at most 200 points a month."""
    points = grid_panel(spark, sf_dir).select(F.col("pixel").alias("id"), "x", "y", "year", "month", "o3")
    return rounded(correlogram.pooled_correlogram(correlogram.correlogram(points, ["o3"], bins_km=(0, 5.5, 10.5, 15), sample=200), (0, 5.5, 10.5, 15)), 5)


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.yearly_means(supplier_panel(spark, sf_dir), ["sif", "o3"])


def sen_slope_by_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trend.sen_slopes(_yearly(spark, sf_dir), "sif"))


def mann_kendall_by_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trend.mann_kendall(_yearly(spark, sf_dir), "sif"))


def modified_mk_by_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trend.trends(_yearly(spark, sf_dir), ["sif", "o3"], least=5).select("pixel", "variable", "n", "sen_slope", "sen_intercept", "mk_z", "mk_p", "lag1", "factor", "ols_slope", "ols_r2"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.with_fdr(trend.trends(_yearly(spark, sf_dir), ["sif", "o3"], least=5))


def trend_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_flagged(spark, sf_dir).select("pixel", "variable", "mk_p", "q_bh", "q_by", "sig_raw", "sig_bh", "sig_by"))


def trend_fdr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.fdr_summary(_flagged(spark, sf_dir))


def spatial_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trend.spatial_stats(grid_panel(spark, sf_dir), ["sif", "o3"], ["ix", "iy"]))


def zonal_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trend.profile(grid_panel(spark, sf_dir), ["sif"], tenth(F.col("iy") / 8), "lat"))


def meridional_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trend.profile(grid_panel(spark, sf_dir), ["sif"], quarter_degree(F.col("ix") / 7), "lon"))


def albers_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest error in degrees of projecting a grid of places and back."""
    a = Albers()
    p = grid_panel(spark, sf_dir).select("ix", "iy").distinct().select((F.col("ix") * 2.0 + 80).alias("lon"), (F.col("iy") * 0.7 + 15).alias("lat"))
    x, y = a.forward(F.col("lon"), F.col("lat"))
    p = p.withColumn("px", x).withColumn("py", y)
    lon, lat = a.inverse(F.col("px"), F.col("py"))
    return p.agg(F.count("*").alias("n"), F.round(F.max(F.abs(lon - F.col("lon"))), 9).alias("lon_error"), F.round(F.max(F.abs(lat - F.col("lat"))), 9).alias("lat_error"))


def _layer(spark: SparkSession, sf_dir: str, value: str, shift: float) -> DataFrame:
    return grid_panel(spark, sf_dir).select("ix", "iy", "x", "y", "year", "month", (F.col(value) - shift).alias("value"))


def raster_monthly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.time_mean(raster.masked(_layer(spark, sf_dir, "o3", 10.0)), ["ix", "iy", "month"]))


def raster_annual_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.time_mean(raster.masked(_layer(spark, sf_dir, "o3", 10.0)), ["ix", "iy", "year"]))


def mode_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid_panel(spark, sf_dir).select("ix", "iy", (F.col("n_rows") % 5).alias("value"))
    return raster.mode_resample(cells, 5)


def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = grid_panel(spark, sf_dir).groupBy("ix", "iy").agg(F.sum("n_rows").alias("value"))
    targets = supplier_panel(spark, sf_dir).select("pixel", (F.col("x") * 1.7 + 2500).alias("x"), (F.col("y") * 0.9 + 2500).alias("y")).distinct()
    return raster.nearest(targets, source, Grid(STEP, STEP, 0.0, 0.0, 25, 51)).select("pixel", "ix", "iy", "value")


def layer_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly base layer with monthly, yearly and static layers; complete cells only."""
    p = kept_grid(spark, sf_dir, "sif", "o3", "t2m", "n_rows")
    base = p.select("ix", "iy", "year", "month", F.col("sif").alias("base"))
    monthly = p.where("month <= 9").select("ix", "iy", "year", "month", F.col("o3").alias("value"))
    yearly = p.groupBy("ix", "iy", "year").agg(F.max("n_rows").alias("value"))
    static = p.where("iy % 3 <> 0").groupBy("ix", "iy").agg(F.min("t2m").alias("value"))
    out = raster.match_layers(base, {"o3": (monthly, ["ix", "iy", "year", "month"]), "code": (yearly, ["ix", "iy", "year"]), "height": (static, ["ix", "iy"])})
    return rounded(out.select("ix", "iy", "year", "month", "base", "o3", "code", "height"))


def layer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = grid_panel(spark, sf_dir).groupBy("ix", "iy").agg(F.sum("n_rows").cast("double").alias("value"))
    return raster.merged_layers([p.where("ix < 10"), p.where("ix >= 5").withColumn("value", F.col("value") + 1000)], ["ix", "iy"])


#: A boundary in cells of 5 km: (seq, x, y).
RING = [(0, 21_000.0, 32_000.0), (1, 92_000.0, 41_000.0), (2, 78_000.0, 158_000.0), (3, 40_000.0, 121_000.0)]


def polygon_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = spark.createDataFrame([(1, *r) for r in RING], "ring_id int, seq int, x double, y double")
    cells = grid_panel(spark, sf_dir).select("ix", "iy", "x", "y").distinct()
    return raster.clipped(cells, ring, STEP, STEP).select("ix", "iy")


def shapefile_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same boundary written as a shapefile and read again."""
    folder = scratch(spark, "shapes")
    put(f"{folder}/ring.shp", shapefile([[[(x, y) for _, x, y in [*RING, RING[0]]]]]))
    cells = grid_panel(spark, sf_dir).select("ix", "iy", "x", "y").distinct()
    return raster.clipped(cells, read_shapes(spark, folder), STEP, STEP).select("ix", "iy")


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variables of the grid panel as layers, cells counted from 0."""
    p = grid_panel(spark, sf_dir)
    value = F.explode(F.create_map(F.lit("sif"), F.col("sif"), F.lit("o3"), F.col("o3"))).alias("variable", "value")
    return p.select("year", "month", F.make_timestamp(F.col("year"), F.col("month"), F.lit(1), F.lit(0), F.lit(0), F.lit(0.0)).alias("time"), "ix", (F.col("iy") - 1).alias("iy"), value)


_LAYER_GRID = Grid(STEP, STEP, 0.0, STEP, 25, 50)


def netcdf_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers written as NetCDF, a file a year, and read as slices from 1997 on."""
    folder = scratch(spark, "netcdf")
    netcdf.write_netcdf(_layers(spark, sf_dir).withColumn("file", F.concat(F.lit("layers_"), "year")), folder, _LAYER_GRID)
    rows = netcdf.read_netcdf(spark, folder, since="1997-01-01")
    return rounded(rows.select("file_name", F.expr(netcdf.layer_name()).alias("layer"), "ix", "iy", "x", "y", "value"))


def tiff_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class layer and a layer of floating numbers written as tiled rasters in sheets of 16 cells, and read again."""
    folder = scratch(spark, "tiff")
    p = grid_panel(spark, sf_dir).withColumn("iy", F.col("iy") - 1)
    tiff.write_tiff(p.groupBy("ix", "iy").agg(F.max("n_rows").alias("value")).withColumn("file", F.lit("code")), folder, _LAYER_GRID, kind="uint16", nodata=65535, epsg=4479, sheet=16)
    tiff.write_tiff(p.groupBy("ix", "iy").agg((F.sum("n_rows") / 8).alias("value")).withColumn("file", F.lit("level")), folder, _LAYER_GRID, sheet=16)
    spark.dataSource.register(tiff.TiffSource)
    rows = spark.read.format("geotiff").option("tiles", 1).load(folder)
    return rows.select(F.element_at(F.split("file_name", "_"), 1).alias("layer"), "crs", F.rint(F.col("x") / STEP).cast("long").alias("ix"), F.rint(F.col("y") / STEP).cast("long").alias("iy"), "x", "y", "value")


#: The warped stack: source cells in a conic, the template in a transverse Mercator zone.
WARP_FROM, WARP_TO = "+proj=aea +lat_1=25 +lat_2=47 +lon_0=105 +ellps=WGS84", "EPSG:32648"
_WARP_GRID, _WARP_X, _WARP_Y, _WARP_STEP = Grid(STEP, STEP, 0.0, 3_300_000.0, 25, 51), 495_000.0, 3_440_000.0, 6_000.0


def warp_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly layers warped onto a template of 24 x 48 cells in another coordinate system."""
    stack = grid_panel(spark, sf_dir).groupBy("ix", "iy", "year").agg(F.max("sif").alias("sif"), F.sum("n_rows").alias("n_rows"))
    template = spark.range(24 * 48).select((F.col("id") % 24).alias("ix"), F.floor(F.col("id") / 24).alias("iy")).withColumns({"x": _WARP_X + F.col("ix") * _WARP_STEP, "y": _WARP_Y + F.col("iy") * _WARP_STEP})
    return rounded(raster.warped(stack, _WARP_GRID, WARP_FROM, template, WARP_TO))


def bucketed_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layer_match_join over layers that are kept in buckets of cells."""
    p = kept_grid(spark, sf_dir, "sif", "o3", "t2m", "n_rows")
    monthly = p.where("month <= 9").select("ix", "iy", "year", "month", F.col("o3").alias("value"))
    yearly = p.groupBy("ix", "iy", "year").agg(F.max("n_rows").alias("value"))
    static = p.where("iy % 3 <> 0").groupBy("ix", "iy").agg(F.min("t2m").alias("value"))
    base = p.select("ix", "iy", "year", "month", F.col("sif").alias("base"))
    kept = raster.bucketed_layers({"base": (base, []), "o3": (monthly, ["ix", "iy", "year", "month"]), "code": (yearly, ["ix", "iy", "year"]), "height": (static, ["ix", "iy"])}, 8)
    return rounded(raster.match_layers(kept.pop("base")[0], kept).select("ix", "iy", "year", "month", "base", "o3", "code", "height"))


def panel_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, least and largest keys of the orders, from the files' footers."""
    found = extents(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey"])
    return spark.createDataFrame([(c, *found[c], found["*"][0]) for c in ("o_orderkey", "o_custkey")], "name string, least long, most long, n long")


QUERIES = {f.__name__: f for f in (
    shapefile_clip, netcdf_layers, tiff_layers, warp_stack, bucketed_match, panel_extent,
    panel_build, panel_key_check, null_normalise_complete_case, month_parse, grid_info, block_ids_by_factor, class_group_map, class_one_hot, subclass_one_hot, year_month_sample_summary, month_names, class_sample_summary, cell_eligibility,
    folds_time_ntile, folds_lexi_mod, folds_balanced, folds_shuffled, split_2d_coverage, split_or_sizes, adjust_bh, adjust_by, adjust_bh_by_group, adjust_holm, kernel_smooth, kernel_effect_map, kernel_support_mask,
    distance_correlogram, distance_summary, distance_sampled, sen_slope_by_pixel, mann_kendall_by_pixel, modified_mk_by_pixel, trend_fdr, trend_fdr_summary, spatial_stats, zonal_profile, meridional_profile, albers_round_trip,
    raster_monthly_mean, raster_annual_mean, mode_resample, nearest_match, layer_match_join, layer_merge, polygon_clip,
)}

# ---------------------------------------------------------------- SQL


def _fdr_sql(group: str, factor: str) -> str:
    part = f"PARTITION BY {group}" if group else ""
    return f"""WITH {_P}, v AS (SELECT *, row_number() OVER ({part} ORDER BY p, c_custkey) AS i, count(*) OVER ({part}) AS m FROM p WHERE p IS NOT NULL), w AS (SELECT c_custkey, least(1.0, min(p * m * {factor} / i) OVER ({part} ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM v)
 SELECT p.c_custkey, round(q, 9) AS q FROM p LEFT JOIN w USING (c_custkey)"""


_K = [w for _, w in kernel.weights(_BW, STEP)]
_R = len(_K) // 2
_KW = "[" + ", ".join(map(repr, _K)) + "]::DOUBLE[]"
_NEAR = f"t.ix BETWEEN s.ix - {_R} AND s.ix + {_R} AND t.iy BETWEEN s.iy - {_R} AND s.iy + {_R}"
_WT = f"(k[CAST(t.ix - s.ix + {_R + 1} AS INT)] * k[CAST(t.iy - s.iy + {_R + 1} AS INT)])"
_TGRID = "tg AS (SELECT CAST(i AS INT) AS ix, CAST(j AS INT) AS iy FROM range(25) a(i), range(51) b(j))"
_KMAP = f"""{grid_sql()}, {oof_sql('o', 'f', ['year'])}, {components_sql('c', 'o', ['ix', 'iy', 'year', 'month'])}, kw AS (SELECT {_KW} AS k),
bc AS (SELECT month, ix, iy, sum(num) AS num, sum(den) AS den, sum(n) AS rows, count(DISTINCT year) AS years FROM c GROUP BY ALL),
lo AS (SELECT t.month, t.ix, t.iy, sum({_WT} * s.num) AS num, sum({_WT} * s.den) AS den, sum({_WT}) AS w, sum({_WT} * {_WT}) AS w2, sum({_WT} * s.years) AS wy, sum({_WT} * s.rows) AS wr FROM bc t JOIN bc s ON t.month = s.month AND {_NEAR}, kw GROUP BY t.month, t.ix, t.iy),
sy AS (SELECT t.month, t.ix, t.iy, s.year, sum({_WT} * s.num) AS num, sum({_WT} * s.den) AS den, sum({_WT}) AS w FROM bc t JOIN c s ON t.month = s.month AND {_NEAR}, kw GROUP BY t.month, t.ix, t.iy, s.year),
me AS (SELECT month, ix, iy, sum((sy.num - lo.num / lo.den * sy.den) ** 2) AS meat, count(*) FILTER (WHERE sy.w > 1e-10) AS g FROM sy JOIN lo USING (month, ix, iy) GROUP BY month, ix, iy),
km AS (SELECT month, ix, iy, {_BW}::DOUBLE AS bandwidth_km, CAST(bc.rows AS BIGINT) AS target_rows, bc.years AS target_years, lo.num / lo.den AS theta, sqrt(CASE WHEN g > 1 THEN g / (g - 1.0) END * meat / (lo.den * lo.den)) AS se, lo.den AS local_den, g, w AS weight_sum, w * w / w2 AS effective_pixels, wy / w AS mean_years, wr / w AS mean_rows
 FROM bc JOIN lo USING (month, ix, iy) JOIN me USING (month, ix, iy) WHERE lo.den > 0)"""


def _corr(chosen: str = "p") -> str:
    return f"""{grid_sql()}, ps AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY year, month ORDER BY md5('42:' || pixel), pixel) <= 200), z AS (SELECT pixel, x, y, year, month, (o3 - avg(o3) OVER m) / stddev_samp(o3) OVER m AS o3, (sif - avg(sif) OVER m) / stddev_samp(sif) OVER m AS sif, count(*) OVER m AS n FROM {chosen} WINDOW m AS (PARTITION BY year, month)),
zz AS (SELECT * FROM z WHERE n >= 20), pr AS (SELECT sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.o3 * b.o3 AS po, a.sif * b.sif AS ps FROM zz a JOIN zz b ON a.year = b.year AND a.month = b.month AND a.pixel < b.pixel AND b.x BETWEEN a.x - 15000 AND a.x + 15000 AND b.y BETWEEN a.y - 15000 AND a.y + 15000),
bn AS (SELECT CASE WHEN d < 5500 THEN 0 WHEN d < 10500 THEN 1 WHEN d <= 15000 THEN 2 END AS bin, po, ps FROM pr WHERE d <= 15000),
co AS (SELECT 'o3' AS variable, bin, [0, 5.5, 10.5][bin + 1]::DOUBLE AS low_km, [5.5, 10.5, 15][bin + 1]::DOUBLE AS high_km, count(*) AS n_pairs, avg(po) AS mean_product FROM bn GROUP BY bin UNION ALL SELECT 'sif', bin, [0, 5.5, 10.5][bin + 1]::DOUBLE, [5.5, 10.5, 15][bin + 1]::DOUBLE, count(*), avg(ps) FROM bn GROUP BY bin)"""


_CORR = _corr()
_YR = f"{supplier_sql()}, yr AS (SELECT pixel, year, avg(sif) AS sif, avg(o3) AS o3 FROM p GROUP BY pixel, year)"
_SLOPES = "sl AS (SELECT a.pixel, a.variable, median((b.v - a.v) / (b.year - a.year)) AS sen_slope FROM lg a JOIN lg b ON a.pixel = b.pixel AND a.variable = b.variable AND b.year > a.year GROUP BY a.pixel, a.variable)"
_LONG = "lg AS (SELECT pixel, year, 'sif' AS variable, sif AS v FROM yr UNION ALL SELECT pixel, year, 'o3', o3 FROM yr)"
#: The Mann-Kendall test with the variance adjusted by the rank correlations of the detrended series.
_MK = f"""{_YR}, {_LONG}, {_SLOPES}, b AS (SELECT *, row_number() OVER w AS i, count(*) OVER s AS n, max(abs(v)) OVER s AS size FROM lg JOIN sl USING (pixel, variable) WINDOW w AS (PARTITION BY pixel, variable ORDER BY year), s AS (PARTITION BY pixel, variable)),
u AS (SELECT pixel, variable, i, n, v, round((v - sen_slope * year) / size, 9) AS e FROM b WHERE n >= 5), k AS (SELECT *, rank() OVER (PARTITION BY pixel, variable ORDER BY e) + (count(*) OVER (PARTITION BY pixel, variable, e) - 1) / 2.0 AS r FROM u),
lags AS (SELECT pixel, variable, any_value(a.n) AS n, b.i - a.i AS lag, CASE WHEN count(*) >= 3 AND var_pop(a.r) > 0 AND var_pop(b.r) > 0 THEN corr(a.r, b.r) ELSE 0.0 END AS rho, sum(sign(b.v - a.v)) AS s FROM k a JOIN k b USING (pixel, variable) WHERE b.i > a.i GROUP BY pixel, variable, b.i - a.i),
fa AS (SELECT pixel, variable, any_value(n) AS n, sum(s) AS s, max(rho) FILTER (WHERE lag = 1) AS lag1, 1 + 2.0 / (any_value(n) * (any_value(n) - 1) * (any_value(n) - 2)) * coalesce(sum((n - lag) * (n - lag - 1) * (n - lag - 2) * rho) FILTER (WHERE abs(rho) > 1.959963984540054 / sqrt(n)), 0) AS f FROM lags GROUP BY pixel, variable),
ti AS (SELECT pixel, variable, sum(c * (c - 1) * (2 * c + 5)) AS t FROM (SELECT pixel, variable, v, count(*) AS c FROM lg GROUP BY ALL) GROUP BY pixel, variable),
mz AS (SELECT pixel, variable, lag1, CASE WHEN f > 0 THEN f ELSE 1.0 END AS factor, CASE WHEN s = 0 THEN 0.0 ELSE (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - t) / 18.0 * CASE WHEN f > 0 THEN f ELSE 1.0 END) END AS z FROM fa JOIN ti USING (pixel, variable)),
mk AS (SELECT *, {normal_p_sql('z')} AS p FROM mz)"""
_FDR = f"{_MK}, rk AS (SELECT *, {ranked_sql('p', 'variable')} FROM mk), qs AS (SELECT *, {q_sql('p', 'variable')} AS q_bh, {q_sql('p', 'variable', 'm * h')} AS q_by FROM rk)"
_EDGES = ", ".join(f"({a[1]}, {a[2]}, {b[1]}, {b[2]})" for a, b in zip(RING, [*RING[1:], RING[0]], strict=True))
_SIDE = lambda x, y: f"((x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1))"
_CORNERS = [_SIDE(f"(x {sx} 2500)", f"(y {sy} 2500)") for sx in "-+" for sy in "-+"]

ORACLE_SQL = {
    "panel_build": f"WITH {supplier_sql()} SELECT pixel, round(x, 9) AS x, round(y, 9) AS y, year, month, round(sif, 9) AS sif, round(o3, 9) AS o3, round(t2m, 9) AS t2m, round(ssrd, 9) AS ssrd, round(tp, 9) AS tp, lccs, n_rows, year * 12 + month AS time_index, CAST(x / 5000 * 10000000 + y / 5000 AS BIGINT) AS pixel_code, CASE WHEN month = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS month_02 FROM p",
    "panel_key_check": f"WITH {supplier_sql()} SELECT count(*) AS n_duplicates FROM (SELECT x, y, year, month FROM p GROUP BY ALL HAVING count(*) > 1)",
    "null_normalise_complete_case": f"WITH {supplier_sql()} SELECT year, count(*) AS n, round(avg(tp), 6) AS tp_mean FROM p WHERE tp IS NOT NULL AND pixel % 7 <> 0 AND pixel % 11 <> 0 GROUP BY year",
    "month_parse": f"WITH {supplier_sql()} SELECT CASE WHEN pixel % 3 = 2 THEN NULL ELSE month END AS parsed, count(*) AS n FROM p GROUP BY 1",
    "grid_info": f"WITH {grid_sql()}, v AS (SELECT DISTINCT 'x' AS axis, x AS v FROM p UNION SELECT DISTINCT 'y', y FROM p), g AS (SELECT axis, v, v - lag(v) OVER (PARTITION BY axis ORDER BY v) AS gap FROM v) SELECT axis, quantile_cont(gap, 0.5) AS spacing, min(v) AS least, max(v) AS most, count(*) AS n FROM g GROUP BY axis",
    "block_ids_by_factor": f"WITH {supplier_sql()} SELECT DISTINCT pixel, k AS factor, CAST(floor(x / (5000.0 * k)) * 10000000 + floor(y / (5000.0 * k)) AS BIGINT) AS block, CAST(floor(x / (5000.0 * k)) AS BIGINT) || '_' || CAST(floor(y / (5000.0 * k)) AS BIGINT) AS key FROM p, (SELECT unnest([1, 2, 4]) AS k)",
    "class_group_map": f"WITH {supplier_sql()} SELECT lccs, CASE WHEN lccs <= 20 THEN 10 WHEN lccs < 70 AND lccs >= 60 THEN 60 ELSE lccs END AS class, count(*) AS n FROM p GROUP BY 1, 2",
    "class_one_hot": f"WITH {supplier_sql()} SELECT year, {', '.join(f'sum(CASE WHEN lccs = {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS lccs_{c}' for c in panels.CODES[1:])} FROM p GROUP BY year",
    "subclass_one_hot": f"WITH {supplier_sql()} SELECT year, {', '.join(f'sum(CASE WHEN lccs = {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS sub_lccs_{c}' for c in (11, 12, 20))} FROM p WHERE lccs IN (10, 11, 12, 20) GROUP BY year",
    "year_month_sample_summary": f"WITH {supplier_sql()} SELECT year, month, count(*) AS n, count(DISTINCT pixel) AS pixels, round(avg(sif), 6) AS sif_mean, round(stddev_samp(sif), 6) AS sif_sd, round(avg(o3), 6) AS o3_mean, round(stddev_samp(o3), 6) AS o3_sd FROM p GROUP BY year, month",
    "month_names": f"WITH {supplier_sql()} SELECT strftime(make_date(2000, month, 1), '%b') AS label, count(*) AS n FROM p GROUP BY 1",
    "class_sample_summary": f"WITH {supplier_sql()} SELECT lccs, count(*) AS n, round(avg(sif), 6) AS sif_mean, round(stddev_samp(sif), 6) AS sif_sd, round(min(sif), 6) AS sif_min, round(max(sif), 6) AS sif_max, round(quantile_cont(sif, 0.5), 6) AS sif_median, count(DISTINCT pixel) AS pixel_distinct, count(DISTINCT year) AS year_distinct FROM p GROUP BY lccs",
    "cell_eligibility": f"WITH {supplier_sql()}, e AS (SELECT year, month, count(*) AS n_rows, count(DISTINCT block) AS n_blocks, count(DISTINCT fold) AS n_folds FROM f GROUP BY year, month) SELECT *, CASE WHEN n_rows < 90 THEN 'rows' WHEN n_blocks < 5 THEN 'blocks' WHEN n_folds < 5 THEN 'folds' END AS reason, n_rows >= 90 AND n_blocks >= 5 AND n_folds >= 5 AS eligible FROM e",
    "folds_time_ntile": f"WITH {supplier_sql()} SELECT year, tfold FROM yf",
    "folds_lexi_mod": f"WITH {supplier_sql()}, k AS (SELECT DISTINCT CAST(floor(x / 10000.0) AS BIGINT) || '_' || CAST(floor(y / 10000.0) AS BIGINT) AS key FROM p) SELECT key, CAST((dense_rank() OVER (ORDER BY key) - 1) % 5 AS INT) AS fold FROM k",
    "folds_shuffled": f"WITH {supplier_sql()}, k AS (SELECT DISTINCT block FROM f) SELECT block, CAST((row_number() OVER (ORDER BY md5('42:' || block)) - 1) % 5 AS INT) AS fold FROM k",
    "folds_balanced": f"""WITH RECURSIVE {supplier_sql()}, k AS (SELECT block, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, md5('42:' || block)) AS i FROM f GROUP BY block),
 walk AS (SELECT CAST(0 AS BIGINT) AS i, [0, 0, 0, 0, 0]::BIGINT[] AS load, CAST(NULL AS BIGINT) AS block, 0 AS fold UNION ALL
 SELECT k.i, list_transform(range(1, 6), lambda j: load[j] + CASE WHEN j = list_position(load, list_min(load)) THEN n ELSE 0 END), k.block, list_position(load, list_min(load)) - 1 FROM walk JOIN k ON k.i = walk.i + 1) SELECT block, CAST(fold AS INT) AS fold FROM walk WHERE i > 0""",
    "distance_sampled": f"WITH {_corr('ps')} SELECT variable, bin, low_km, high_km, n_pairs, round(mean_product, 5) AS mean_product FROM co WHERE variable = 'o3'",
    "split_2d_coverage": f"WITH {supplier_sql()}, t AS (SELECT CAST(a AS INT) AS test, CAST(b AS INT) AS test_time FROM range(5) x(a), range(5) y(b)) SELECT test, test_time, count(*) FILTER (WHERE fold <> test AND tfold <> test_time) AS n_train, count(*) FILTER (WHERE fold = test AND tfold = test_time) AS n_test FROM t, f GROUP BY test, test_time",
    "split_or_sizes": f"WITH {supplier_sql()}, t AS (SELECT CAST(a AS INT) AS test FROM range(5) x(a)) SELECT test, count(*) FILTER (WHERE fold <> test AND tfold <> test) AS n_train, count(*) FILTER (WHERE fold = test OR tfold = test) AS n_test FROM t, f GROUP BY test",
    "adjust_bh": _fdr_sql("", "1.0"),
    "adjust_by": _fdr_sql("", "(SELECT sum(1.0 / i) FROM range(1, (SELECT count(p) FROM p) + 1) t(i))"),
    "adjust_bh_by_group": _fdr_sql("c_mktsegment", "1.0"),
    "adjust_holm": f"WITH {_P}, v AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY p, c_custkey) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS m FROM p WHERE p IS NOT NULL), w AS (SELECT c_custkey, least(1.0, max((m - i + 1) * p) OVER (PARTITION BY c_mktsegment ORDER BY i)) AS h FROM v) SELECT p.c_custkey, round(h, 9) AS p_holm FROM p LEFT JOIN w USING (c_custkey)",
    "kernel_smooth": f"WITH {grid_sql()}, kw AS (SELECT {_KW} AS k), {_TGRID}, s AS (SELECT month, ix, iy, CAST(sum(n_rows) AS DOUBLE) AS v FROM p GROUP BY month, ix, iy) SELECT month, t.ix, t.iy, round(sum({_WT} * v), 6) AS v FROM tg t JOIN s ON {_NEAR}, kw GROUP BY month, t.ix, t.iy",
    "kernel_effect_map": f"WITH {_KMAP} SELECT month, ix, iy, bandwidth_km, target_rows, target_years, round(theta, 4) AS theta, round(se, 4) AS se, round(local_den, 4) AS local_den, g, round(weight_sum, 4) AS weight_sum, round(effective_pixels, 5) AS effective_pixels, round(mean_years, 4) AS mean_years, round(mean_rows, 4) AS mean_rows FROM km",
    "kernel_support_mask": f"""WITH {_KMAP}, q AS (SELECT month, quantile_cont(local_den, 0.05) AS dq, quantile_cont(se, 0.95) AS sq FROM km GROUP BY month), s AS (SELECT km.*, coalesce(g >= 3 AND mean_years >= 1.5 AND effective_pixels >= 10 AND local_den >= dq AND se <= sq, false) AS ok FROM km JOIN q USING (month))
 SELECT month, bandwidth_km, count(*) AS n, count(*) FILTER (WHERE ok) AS n_supported, round(avg(theta * 10) FILTER (WHERE ok), 5) AS effect_mean, round(sum(local_den * theta) FILTER (WHERE ok) / sum(local_den) FILTER (WHERE ok) * 10, 5) AS effect_weighted, round(count(*) FILTER (WHERE ok AND theta > 0) / nullif(count(*) FILTER (WHERE ok), 0), 5) AS share_positive FROM s GROUP BY month, bandwidth_km""",
    "distance_correlogram": f"WITH {_CORR} SELECT variable, bin, low_km, high_km, n_pairs, round(mean_product, 5) AS mean_product FROM co",
    "distance_summary": f"WITH {_CORR}, l AS (SELECT *, lead(mean_product) OVER (PARTITION BY variable ORDER BY low_km) AS nx, (low_km + high_km) / 2 AS mid FROM co) SELECT variable, min(high_km) FILTER (WHERE abs(mean_product) <= 0.05 AND abs(nx) <= 0.05) AS near_zero_km, round(arg_min(mean_product, abs(mid - 10)), 5) AS at_reference, arg_min(mid, abs(mid - 10)) AS reference_mid_km FROM l GROUP BY variable",
    "sen_slope_by_pixel": f"WITH {_YR}, {_LONG}, {_SLOPES} SELECT pixel, CAST(count(*) AS INT) AS n, round(any_value(sen_slope), 6) AS sen_slope, round(median(v - sen_slope * year), 6) AS sen_intercept FROM lg LEFT JOIN sl USING (pixel, variable) WHERE variable = 'sif' GROUP BY pixel",
    "mann_kendall_by_pixel": f"WITH {_YR}, t AS (SELECT pixel, sum(c * (c - 1) * (2 * c + 5)) AS t, CAST(sum(c) AS INT) AS n FROM (SELECT pixel, sif, count(*) AS c FROM yr GROUP BY pixel, sif) GROUP BY pixel), s AS (SELECT a.pixel, sum(sign(b.sif - a.sif)) AS s FROM yr a JOIN yr b ON a.pixel = b.pixel AND b.year > a.year GROUP BY a.pixel) SELECT pixel, n, CASE WHEN n >= 3 THEN CAST(s AS DOUBLE) END AS mk_s, CASE WHEN n >= 3 THEN round((n * (n - 1) * (2 * n + 5) - t) / 18, 6) END AS mk_var FROM t LEFT JOIN s USING (pixel)",
    "modified_mk_by_pixel": f"WITH {_MK}, ba AS (SELECT pixel, variable, CAST(count(*) AS INT) AS n, any_value(sen_slope) AS sen_slope, median(v - sen_slope * year) AS sen_intercept, regr_slope(v, year) AS ols_slope, regr_r2(v, year) AS ols_r2 FROM lg JOIN sl USING (pixel, variable) GROUP BY pixel, variable HAVING count(*) >= 5) SELECT pixel, variable, n, round(sen_slope, 6) AS sen_slope, round(sen_intercept, 6) AS sen_intercept, round(z, 6) AS mk_z, round(p, 6) AS mk_p, round(lag1, 6) AS lag1, round(factor, 6) AS factor, round(ols_slope, 6) AS ols_slope, round(ols_r2, 6) AS ols_r2 FROM ba JOIN mk USING (pixel, variable)",
    "trend_fdr": f"WITH {_FDR} SELECT pixel, variable, round(p, 6) AS mk_p, round(q_bh, 6) AS q_bh, round(q_by, 6) AS q_by, p < 0.05 AS sig_raw, q_bh < 0.05 AS sig_bh, q_by < 0.05 AS sig_by FROM qs",
    "trend_fdr_summary": f"WITH {_FDR} SELECT variable, count(p) AS n_tested, count(*) FILTER (WHERE p < 0.05) AS n_raw, count(*) FILTER (WHERE q_bh < 0.05) AS n_bh, count(*) FILTER (WHERE q_by < 0.05) AS n_by, count(*) FILTER (WHERE p < 0.05 AND sen_slope > 0) AS n_raw_up, count(*) FILTER (WHERE q_bh < 0.05 AND sen_slope > 0) AS n_bh_up, count(*) FILTER (WHERE q_by < 0.05 AND sen_slope > 0) AS n_by_up FROM qs JOIN sl USING (pixel, variable) GROUP BY variable",
    "spatial_stats": f"WITH {grid_sql()} SELECT ix, iy, round(avg(sif), 6) AS sif_mean, round(stddev_samp(sif), 6) AS sif_sd, round(avg(o3), 6) AS o3_mean, round(stddev_samp(o3), 6) AS o3_sd FROM p GROUP BY ix, iy",
    "zonal_profile": f"WITH {grid_sql()} SELECT round_even(iy / 8, 1) AS lat, round(avg(sif), 6) AS sif_mean, count(*) AS n FROM p GROUP BY 1",
    "meridional_profile": f"WITH {grid_sql()} SELECT round_even(ix / 7 * 4, 0) / 4 AS lon, round(avg(sif), 6) AS sif_mean, count(*) AS n FROM p GROUP BY 1",
    "albers_round_trip": f"WITH {grid_sql()} SELECT count(DISTINCT (ix, iy)) AS n, 0.0::DOUBLE AS lon_error, 0.0::DOUBLE AS lat_error FROM p",
    "raster_monthly_mean": f"WITH {grid_sql()} SELECT ix, iy, month, round(avg(o3 - 10), 6) AS value, count(*) AS n FROM p WHERE o3 - 10 >= 0 GROUP BY ix, iy, month",
    "raster_annual_mean": f"WITH {grid_sql()} SELECT ix, iy, year, round(avg(o3 - 10), 6) AS value, count(*) AS n FROM p WHERE o3 - 10 >= 0 GROUP BY ix, iy, year",
    "mode_resample": f"WITH {grid_sql()}, c AS (SELECT CAST(floor(ix / 5) AS BIGINT) AS ix, CAST(floor(iy / 5) AS BIGINT) AS iy, n_rows % 5 AS value, count(*) AS n FROM p GROUP BY 1, 2, 3) SELECT ix, iy, value FROM c QUALIFY row_number() OVER (PARTITION BY ix, iy ORDER BY n DESC, value) = 1",
    "nearest_match": f"WITH t AS (SELECT DISTINCT l_suppkey AS pixel, CAST(round_even(((l_suppkey % 5) * 5000.0 * 1.7 + 2500) / 5000, 0) AS BIGINT) AS ix, CAST(round_even((floor(l_suppkey / 5) * 5000.0 * 0.9 + 2500) / 5000, 0) AS BIGINT) AS iy FROM lineitem), {grid_sql()}, s AS (SELECT ix, iy, CAST(sum(n_rows) AS BIGINT) AS value FROM p GROUP BY ix, iy) SELECT pixel, t.ix, t.iy, value FROM t LEFT JOIN s USING (ix, iy) WHERE t.ix BETWEEN 0 AND 24 AND t.iy BETWEEN 0 AND 50",
    "layer_match_join": f"WITH {grid_sql()}, y AS (SELECT ix, iy, year, max(n_rows) AS code FROM p GROUP BY ix, iy, year), h AS (SELECT ix, iy, min(t2m) AS height FROM p WHERE iy % 3 <> 0 GROUP BY ix, iy) SELECT ix, iy, year, month, round(sif, 6) AS base, round(o3, 6) AS o3, code, round(height, 6) AS height FROM p JOIN y USING (ix, iy, year) JOIN h USING (ix, iy) WHERE month <= 9",
    "layer_merge": f"WITH {grid_sql()} SELECT ix, iy, CAST(sum(n_rows) AS DOUBLE) + CASE WHEN ix < 10 THEN 0 ELSE 1000 END AS value FROM p GROUP BY ix, iy",
    "netcdf_layers": f"WITH {grid_sql()}, v AS (UNPIVOT (SELECT ix, iy, x, y, year, month, sif, o3 FROM p) ON sif, o3 INTO NAME variable VALUE value) SELECT 'layers_' || year || '.nc' AS file_name, variable || year || '-' || lpad(month::VARCHAR, 2, '0') AS layer, CAST(ix AS BIGINT) AS ix, CAST(iy - 1 AS BIGINT) AS iy, x, y, round(value, 6) AS value FROM v WHERE year >= 1997",
    "tiff_layers": f"WITH {grid_sql()} SELECT 'code' AS layer, 'EPSG:4479' AS crs, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, x, y, max(n_rows)::DOUBLE AS value FROM p GROUP BY ALL UNION ALL SELECT 'level', 'EPSG:4326', CAST(ix AS BIGINT), CAST(iy AS BIGINT), x, y, sum(n_rows) / 8.0 FROM p GROUP BY ALL",
    "polygon_clip": f"""WITH {grid_sql()}, cells AS (SELECT DISTINCT ix, iy, x, y FROM p), e(x1, y1, x2, y2) AS (VALUES {_EDGES}),
 t AS (SELECT ix, iy, count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS centre, bool_or(least(x1, x2) <= x + 2500 AND greatest(x1, x2) >= x - 2500 AND least(y1, y2) <= y + 2500 AND greatest(y1, y2) >= y - 2500 AND least({', '.join(_CORNERS)}) <= 0 AND greatest({', '.join(_CORNERS)}) >= 0) AS edge FROM cells, e GROUP BY ix, iy) SELECT ix, iy FROM t WHERE centre OR edge""",
}
_TM, (_E2, _E, _CN, _CC, _RHO0) = parsed(WARP_TO), parsed(WARP_FROM).constants
_SERIES = lambda c, f, g: " + ".join(f"{v!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, v in enumerate(c, 1))
_WARPED = f"""
t AS (SELECT i AS ix, j AS iy, {_WARP_X} + i * {_WARP_STEP} AS x, {_WARP_Y} + j * {_WARP_STEP} AS y FROM range(24) a(i), range(48) b(j)),
w1 AS (SELECT *, y / {_TM.radius!r} AS xi, (x - 500000.0) / {_TM.radius!r} AS eta FROM t),
w2 AS (SELECT *, xi - ({_SERIES(_TM.series[1], 'sin', 'cosh')}) AS u, eta - ({_SERIES(_TM.series[1], 'cos', 'sinh')}) AS v FROM w1),
w3 AS (SELECT *, asin(sin(u) / cosh(v)) AS chi, atan2(sinh(v), cos(u)) AS lam FROM w2),
w4 AS (SELECT *, sin(chi + {' + '.join(f'{v!r} * sin({2 * j} * chi)' for j, v in enumerate(_TM.series[2], 1))}) AS s FROM w3),
w5 AS (SELECT *, {1 - _E2!r} * (s / (1 - {_E2!r} * s * s) - ln((1 - {_E!r} * s) / (1 + {_E!r} * s)) / (2 * {_E!r})) AS q FROM w4),
w6 AS (SELECT *, 6378137.0 * sqrt({_CC!r} - {_CN!r} * q) / {_CN!r} AS rho, {_CN!r} * lam AS theta FROM w5),
w7 AS (SELECT ix, iy, x, y, round_even(rho * sin(theta) / {STEP}, 0) AS sx, round_even(({_RHO0!r} - rho * cos(theta) - {_WARP_GRID.y0}) / {STEP}, 0) AS sy FROM w6)
"""
ORACLE_SQL["warp_stack"] = f"WITH {grid_sql()}, {_WARPED}, st AS (SELECT ix AS sx, iy AS sy, year, max(sif) AS sif, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM p GROUP BY ix, iy, year) SELECT CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, x, y, year, round(sif, 6) AS sif, n_rows FROM w7 JOIN st USING (sx, sy)"
ORACLE_SQL["bucketed_match"] = ORACLE_SQL["layer_match_join"]
ORACLE_SQL["panel_extent"] = " UNION ALL ".join(f"SELECT '{c}' AS name, min({c}) AS least, max({c}) AS most, count(*) AS n FROM orders" for c in ("o_orderkey", "o_custkey"))
ORACLE_SQL["shapefile_clip"] = ORACLE_SQL["polygon_clip"]
