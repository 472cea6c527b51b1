"""Queries about result tables: fits of the nuisance models, support, specifications, response curves, checked joins and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Albers
from ..operators import climate, crossfit, diagnostics, features, inference, raster
from ..operators.components import components
from ..operators.folds import Split
from ..sources.layers import vertices
from ..sources.sinks import kept
from . import panels
from .describe import ORACLE_SQL as _DESCRIBED
from .describe import RING
from .effects import _CLASSES, _CMOD, _FULL, _YEARLY, class_components, climate_components, monthly_components, yearly_residuals
from .panels import STEP, grid_panel, grid_sql, oof_sql, rounded, supplier_panel, supplier_rows, supplier_sql

STAGES = {"exposure": "o3", "outcome": "sif"}
THRESHOLDS = [20, 60, 100]


def nuisance_fit_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = diagnostics.staged_metrics(yearly_residuals(spark, sf_dir), STAGES, ["tfold", "year"])
    return rounded(diagnostics.weighted_fit(per, ["tfold", "stage"]))


def residual_moments_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = yearly_residuals(spark, sf_dir).groupBy("year").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return rounded(diagnostics.combined_moments(yearly, [], "n", "mean", "sd"))


def month_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = inference.one_way(monthly_components(spark, sf_dir), ["year", "month"], "block")
    return rounded(diagnostics.support_table(cells, ["month"], "n", "year"))


def nuisance_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.sanity(diagnostics.staged_metrics(yearly_residuals(spark, sf_dir), STAGES, ["year", "month"]), ["stage"]))


def threshold_nuisance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_rows(spark, sf_dir).withColumn("class", features.class_group(F.col("lccs"))).where("class is not null")
    fit = diagnostics.staged_metrics(crossfit.oof_residuals(rows, "o3", "sif", ["t2m"], strata=["class", "year"]), STAGES, ["class", "year"])
    return rounded(diagnostics.threshold_support(fit, ["class"], "n", "r2", THRESHOLDS))


def _specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, both = supplier_rows(spark, sf_dir), Split("both", panels.FOLDS, panels.FOLDS)
    primary = yearly_residuals(spark, sf_dir)
    full = crossfit.oof_residuals(rows, "o3", "sif", ["t2m"], both)
    pooled = lambda out: inference.with_t(inference.two_way(components(out, ["block", "year"]), [], "block", "year"))
    return diagnostics.specification(primary, pooled(primary), "primary").unionByName(diagnostics.specification(full, pooled(full), "full_period"))


def specification_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.specification_deltas(_specifications(spark, sf_dir), {"architecture": ("primary", "full_period")}))


def variation_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.variation_ratios(_specifications(spark, sf_dir), ["primary"])
    return rounded(out.select("design", "n", "theta", "residual_sd", "den_per_row", "sd_to_primary", "information_to_primary"))


def climate_response_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(climate_components(spark, sf_dir).select("block", "year", "month", "num", "den", "t2m_anomaly"), "climate-components")
    return rounded(climate.response_curves(rows, climate.fitted(rows)).select("curve", "point", "anomaly", "effect"), 5)


def keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last month of every pixel."""
    return rounded(features.latest(supplier_panel(spark, sf_dir), ["pixel"], F.col("year") * 12 + F.col("month")).select("pixel", "year", "month", "sif"))


def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of classes in the order of a given list."""
    out = inference.effects(class_components(spark, sf_dir), ["class"])
    return rounded(features.in_order(out.select("class", "theta"), "class", [120, 60, 10, 90]))


def class_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = features.looked_up(supplier_panel(spark, sf_dir), "lccs", {c: f"code {c}" for c in panels.CODES}, "label")
    return named.groupBy("label").agg(F.count("*").alias("n"))


def effects_with_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual effects joined to the annual fit of the outcome, at most one row each."""
    out = yearly_residuals(spark, sf_dir)
    fit = diagnostics.fit_metrics(out, "sif", "sif_hat", ["year"]).select("year", "r2", "rmse").where("year % 2 = 0")
    return rounded(features.joined_once(inference.effects(components(out, ["year", "block"]), ["year"]).select("year", "theta"), fit, ["year"]))


def reproject_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in degrees turned into metres of the equal-area projection, and the 25 km cell each falls in."""
    cells = grid_panel(spark, sf_dir).select("ix", "iy").distinct().select("ix", "iy", (F.col("ix") * 2.0 + 80).alias("x"), (F.col("iy") * 0.7 + 15).alias("y"))
    out = raster.reprojected(cells, Albers())
    return out.select("ix", "iy", F.round(F.col("x") / 1000, 4).alias("x_km"), F.round(F.col("y") / 1000, 4).alias("y_km"), F.rint(F.col("x") / 25000).cast("long").alias("cx"), F.rint(F.col("y") / 25000).cast("long").alias("cy"), "crs")


def wkt_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a polygon given as text touches."""
    text = ", ".join(f"{x} {y}" for _, x, y in [*RING, RING[0]])
    ring = vertices(spark.createDataFrame([(f"POLYGON (({text}))",)], "wkt string"))
    return raster.clipped(grid_panel(spark, sf_dir).select("ix", "iy", "x", "y").distinct(), ring, STEP, STEP).select("ix", "iy")


QUERIES = {f.__name__: f for f in (
    nuisance_fit_weighted, residual_moments_pooled, month_support, nuisance_sanity, threshold_nuisance, specification_deltas, variation_ratios, climate_response_curves,
    keep_latest, group_order, class_lookup, effects_with_fit, reproject_nearest, wkt_clip,
)}

# ---------------------------------------------------------------- SQL


def _fits(source: str, keys: str) -> str:
    return f"SELECT {keys}, stage, count(*) AS n, CASE WHEN count(*) > 1 AND var_pop(y) > 0 THEN 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) END AS r2 FROM (SELECT {keys}, 'exposure' AS stage, o3 AS y, o3_hat AS p FROM {source} UNION ALL SELECT {keys}, 'outcome', sif, sif_hat FROM {source}) GROUP BY {keys}, stage"


_SPEC = f"""a_o AS (SELECT * FROM (WITH {_YEARLY} SELECT block, year, d, r FROM o)), b_o AS (SELECT * FROM (WITH {_FULL} SELECT block, year, d, r FROM o)),
sp AS (SELECT 'primary' AS design, count(*) AS n, sum(d * r) / sum(d * d) AS theta, stddev_samp(d) AS residual_sd, sum(d * d) / count(*) AS den_per_row FROM a_o UNION ALL SELECT 'full_period', count(*), sum(d * r) / sum(d * d), stddev_samp(d), sum(d * d) / count(*) FROM b_o)"""


def _albers_sql() -> str:
    al = Albers()
    e2, e, n, c, rho0 = al.constants
    s = "sin(radians(y))"
    q = f"((1 - {e2!r}) * ({s} / (1 - {e2!r} * {s} * {s}) - ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / (2 * {e!r})))"
    return f"""c AS (SELECT DISTINCT ix, iy, ix * 2.0 + 80 AS x, iy * 0.7 + 15 AS y FROM p), r AS (SELECT ix, iy, {al.a!r} * sqrt({c!r} - {n!r} * {q}) / {n!r} AS rho, {n!r} * radians(x - {al.lon0!r}) AS t FROM c),
m AS (SELECT ix, iy, rho * sin(t) AS x, {rho0!r} - rho * cos(t) AS y FROM r)"""


ORACLE_SQL = {
    "nuisance_fit_weighted": f"WITH {_YEARLY}, m AS ({_fits('o', 'tfold, year')}) SELECT tfold, stage, CAST(sum(n) AS BIGINT) AS n, round(sum(n * r2) / sum(n) FILTER (WHERE r2 IS NOT NULL), 6) AS r2_weighted FROM m GROUP BY tfold, stage",
    "residual_moments_pooled": f"WITH {_YEARLY} SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd FROM o",
    "month_support": f"WITH {supplier_sql()}, {oof_sql('o', 'f', ['year', 'month'])}, c AS (SELECT year, month, count(*) AS n FROM o GROUP BY year, month) SELECT month, count(DISTINCT year) AS n_year, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, min(n) AS least, median(n) AS median, max(n) AS most FROM c GROUP BY month",
    "nuisance_sanity": f"WITH {_YEARLY}, m AS ({_fits('o', 'year, month')}) SELECT stage, count(r2) AS n_fits, round(avg(r2), 6) AS mean, round(median(r2), 6) AS median, round(min(r2), 6) AS least, round(max(r2), 6) AS most, count(*) FILTER (WHERE r2 < 0) AS n_negative FROM m GROUP BY stage",
    "threshold_nuisance": f"WITH {_CLASSES}, m AS ({_fits('o', 'class, year')}) SELECT class, stage, threshold, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_rows, round(quantile_cont(r2, 0.05), 6) AS q05, round(median(r2), 6) AS median, round(min(r2), 6) AS least FROM m, (SELECT unnest({THRESHOLDS}) AS threshold) WHERE n >= threshold GROUP BY class, stage, threshold",
    "specification_deltas": f"""WITH {_SPEC}, ya AS (SELECT list([year, n] ORDER BY year) AS l FROM (SELECT year, count(*) AS n FROM a_o GROUP BY year)), yb AS (SELECT list([year, n] ORDER BY year) AS l FROM (SELECT year, count(*) AS n FROM b_o GROUP BY year))
 SELECT 'architecture' AS contrast, 'primary' AS a, 'full_period' AS b, x.n = y.n AND ya.l = yb.l AS same_rows, CASE WHEN x.n = y.n AND ya.l = yb.l THEN round(y.theta - x.theta, 6) END AS delta FROM sp x, sp y, ya, yb WHERE x.design = 'primary' AND y.design = 'full_period'""",
    "variation_ratios": f"WITH {_SPEC} SELECT s.design, s.n, round(s.theta, 6) AS theta, round(s.residual_sd, 6) AS residual_sd, round(s.den_per_row, 6) AS den_per_row, round(s.residual_sd / b.residual_sd, 6) AS sd_to_primary, round(s.den_per_row / b.den_per_row, 6) AS information_to_primary FROM sp s, sp b WHERE b.design = 'primary'",
    "climate_response_curves": f"""WITH {_CMOD}, lim AS (SELECT quantile_cont(a, 0.05) AS lo, quantile_cont(a, 0.95) AS hi FROM cs), pts AS (SELECT CAST(i AS INT) AS point, lo + (hi - lo) * i / 120.0 AS anomaly FROM lim, range(121) t(i)),
 cu AS (SELECT 'mean' AS curve, avg(b) AS b FROM be WHERE month < 99 UNION ALL SELECT lpad(CAST(month AS VARCHAR), 2, '0'), b FROM be WHERE month < 99) SELECT curve, point, round(anomaly, 5) AS anomaly, round((b + gamma * anomaly) * 10, 5) AS effect FROM cu, pts, de""",
    "keep_latest": f"WITH {supplier_sql()} SELECT pixel, year, month, round(sif, 6) AS sif FROM p QUALIFY row_number() OVER (PARTITION BY pixel ORDER BY year DESC, month DESC) = 1",
    "group_order": f"WITH {_CLASSES} SELECT class, round(sum(num) / sum(den), 6) AS theta, CAST(coalesce(list_position([120, 60, 10, 90], class), 5) AS INT) AS position FROM c GROUP BY class ORDER BY position, class",
    "class_lookup": f"WITH {supplier_sql()} SELECT 'code ' || lccs AS label, count(*) AS n FROM p GROUP BY lccs",
    "effects_with_fit": f"WITH {_YEARLY}, h AS (SELECT year, sum(d * r) / sum(d * d) AS theta FROM o GROUP BY year), m AS (SELECT year, 1 - sum(r * r) / (var_pop(sif) * count(*)) AS r2, sqrt(avg(r * r)) AS rmse FROM o WHERE year % 2 = 0 GROUP BY year) SELECT year, round(theta, 6) AS theta, round(r2, 6) AS r2, round(rmse, 6) AS rmse FROM h LEFT JOIN m USING (year)",
    "reproject_nearest": f"WITH {grid_sql()}, {_albers_sql()} SELECT ix, iy, round(x / 1000, 4) AS x_km, round(y / 1000, 4) AS y_km, CAST(round_even(x / 25000, 0) AS BIGINT) AS cx, CAST(round_even(y / 25000, 0) AS BIGINT) AS cy, 'albers' AS crs FROM m",
    "wkt_clip": _DESCRIBED["polygon_clip"],
}
