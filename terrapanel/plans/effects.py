"""Queries about effects: cross-fitted residuals, components, pooled and stratified effects and their tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosted, bootstrap, climate, crossfit, diagnostics, features, inference, tuning
from ..operators.components import components, score_cells
from ..operators.folds import Split
from ..operators.multiplicity import fdr
from ..sources.sinks import kept
from . import panels
from .panels import components_sql, oof_sql, rounded, supplier_rows, supplier_sql, two_way_sql
from .tails import critical_sql, normal_p_sql, q_sql, ranked_sql, sign_p_sql, t_p_sql

TESTED = ["t_df", "effect", "effect_se", "ci_normal_low", "ci_normal_high", "ci_t_low", "ci_t_high", "p_normal", "p_t"]
EFFECT = ["theta", "se", "fallback", "g1", "g2", "g12", "num", "den", "n"]
_EFFECT = "round(theta, 6) AS theta, round(se, 6) AS se, fallback, g1, g2, g12, round(num, 3) AS num, round(den, 3) AS den, n"


def shown(df: DataFrame, *keys: str) -> DataFrame:
    return rounded(df.select(*keys, *EFFECT), 6, num=3, den=3)


def yearly_residuals(spark: SparkSession, sf_dir: str, factor: int = panels.FACTOR) -> DataFrame:
    """The primary design: a model a year, blocks held out."""
    return crossfit.oof_residuals(supplier_rows(spark, sf_dir, factor, ["o3", "sif", "t2m"]), "o3", "sif", ["t2m"], strata=["year"])


def yearly_components(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return components(yearly_residuals(spark, sf_dir), list(keys or ("block", "year")))


_YEARLY = f"{supplier_sql()}, {oof_sql('o', 'f', ['year'])}"


def oof_residuals_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(yearly_residuals(spark, sf_dir).select("pixel", "year", "month", "fold", "d", "r"))


def components_block_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(yearly_components(spark, sf_dir).select("block", "year", "num", "den", "n"), 4)


def oof_metrics_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.staged_metrics(yearly_residuals(spark, sf_dir), {"exposure": "o3", "outcome": "sif"}, ["year"]))


def effect_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(inference.two_way(yearly_components(spark, sf_dir, "year", "block", "month"), ["year"], "block", "month"), "year")


def effect_by_year_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With t and normal intervals, p values and q values over the years."""
    out = inference.with_t(inference.two_way(yearly_components(spark, sf_dir, "year", "block", "month"), ["year"], "block", "month"))
    return rounded(fdr(out, "p_t").select("year", *TESTED, "q"))


def effect_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: yearly models pooled, clustered by block and year."""
    return shown(inference.two_way(yearly_components(spark, sf_dir), [], "block", "year"))


def effect_pooled_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    comp = yearly_components(spark, sf_dir)
    out = inference.with_t(inference.two_way(comp, [], "block", "year")).crossJoin(inference.annual_signs(comp.withColumn("k", F.lit(1)), ["k"]).drop("k"))  # a row each
    return rounded(out.select(*TESTED, "n_years", "n_negative", "median_effect", "sign_p"))


def effect_month_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.annual_signs(monthly_components(spark, sf_dir), ["month"]))


def monthly_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crossfit.oof_residuals(supplier_rows(spark, sf_dir), "o3", "sif", ["t2m"], strata=["year", "month"])
    return components(rows, ["month", "year", "block"])


def effect_month_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month x year cells with one-way clusters."""
    out = inference.one_way(monthly_components(spark, sf_dir), ["year", "month"], "block")
    return rounded(out.select("year", "month", "theta", "se", "g1", "n"), 5)


def effect_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(inference.two_way(monthly_components(spark, sf_dir), ["month"], "block", "year"), "month")


def class_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_rows(spark, sf_dir).withColumn("class", features.class_group(F.col("lccs"))).where("class is not null")
    return components(crossfit.oof_residuals(rows, "o3", "sif", ["t2m"], strata=["class", "year"]), ["class", "year", "block"])


_CLASS = "CASE WHEN lccs IN (10, 11, 12, 20) THEN 10 WHEN lccs IN (60, 61, 62) THEN 60 WHEN lccs IN (70, 71, 72) THEN 70 WHEN lccs IN (80, 81, 82) THEN 80 WHEN lccs IN (120, 121, 122) THEN 120 WHEN lccs IN (50, 90, 130) THEN lccs END"
_CLASSES = f"{supplier_sql()}, fc AS (SELECT *, {_CLASS} AS class FROM f WHERE {_CLASS} IS NOT NULL), {oof_sql('o', 'fc', ['class', 'year'])}, {components_sql('c', 'o', ['class', 'year', 'block'])}"


def effect_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(inference.two_way(class_components(spark, sf_dir), ["class"], "block", "year"), "class")


def month_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar months by years: the cells' effects as a wide table of twelve rows."""
    return diagnostics.heat_table(effect_month_cells(spark, sf_dir), "month", list(range(1, 13)), "theta")


def class_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land-cover classes by years."""
    cells = class_components(spark, sf_dir).groupBy("class", "year").agg((F.sum("num") / F.sum("den")).alias("theta"))
    return diagnostics.heat_table(rounded(cells, 5), "class", None, "theta")


def effect_block_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for factor in (1, 2, 4):
        one = inference.two_way(components(yearly_residuals(spark, sf_dir, factor), ["block", "year"]), [], "block", "year").withColumn("factor", F.lit(factor))
        out = one if out is None else out.unionByName(one)
    return shown(out, "factor")


def effect_control_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two covariate sets on the rows that are complete for both."""
    rows = supplier_rows(spark, sf_dir).dropna(subset=["t2m", "ssrd", "tp"])
    out = None
    for name in ("t2m", "ssrd", "tp"):
        comp = components(crossfit.oof_residuals(rows, "o3", "sif", [name], strata=["year"]), ["block", "year"])
        one = inference.two_way(comp, [], "block", "year").withColumn("control", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return shown(out, "control")


def effect_wide_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All covariates, month effects and class dummies at once, over the full period."""
    rows, dummies = features.one_hot(features.time_features(supplier_rows(spark, sf_dir)).dropna(subset=["t2m", "ssrd", "tp"]), "lccs", list(panels.CODES))
    controls = ["t2m", "ssrd", "tp", "year_centered", *features.month_names().values(), *dummies[:5]]
    comp = components(crossfit.oof_residuals(rows, "o3", "sif", controls), ["block", "year"])
    return shown(inference.two_way(comp, [], "block", "year"))


def full_period_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossfit.oof_residuals(supplier_rows(spark, sf_dir), "o3", "sif", ["t2m"], Split("both", panels.FOLDS, panels.FOLDS))


def effect_full_period_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(inference.two_way(components(full_period_rows(spark, sf_dir), ["block", "year"]), [], "block", "year", small=False))


_FULL = f"{supplier_sql()}, {oof_sql('o', 'f', [], kind='both')}"


def within_pixel_year_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.within_pixel_year(supplier_rows(spark, sf_dir), ["sif", "o3", "t2m"])
    return rounded(out.select("pixel", "year", "month", "group_size", "sif_w", "o3_w", "t2m_w"), 8)


def effect_strict_fe(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = features.within_pixel_year(supplier_rows(spark, sf_dir), ["sif", "o3", "t2m"])
    comp = components(crossfit.oof_residuals(w, "o3_w", "sif_w", ["t2m_w"], strata=["year"]), ["block", "year"])
    return shown(inference.two_way(comp, [], "block", "year"))


def within_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = features.within_pixel_month(supplier_rows(spark, sf_dir), ["sif", "o3"])
    return rounded(features.within_audit(w, ["pixel", "month"], ["sif", "o3"]), 9)


def effect_interannual(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = features.within_pixel_month(supplier_rows(spark, sf_dir), ["sif", "o3", "t2m"])
    comp = components(crossfit.oof_residuals(w, "o3_w", "sif_w", ["t2m_w"]), ["block", "year"])
    return shown(inference.two_way(comp, [], "block", "year"))


def paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and anomaly residuals side by side on the same rows and folds."""
    w = features.within_pixel_month(supplier_rows(spark, sf_dir), ["sif", "o3", "t2m"])
    raw = crossfit.oof_residuals(w, "o3", "sif", ["t2m"]).withColumnsRenamed({"d": "d_raw", "r": "r_raw"}).drop("test")
    return crossfit.oof_residuals(raw, "o3_w", "sif_w", ["t2m_w"]).withColumnsRenamed({"d": "d_an", "r": "r_an"})


def paired_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.paired_contrast(paired_rows(spark, sf_dir), ("d_raw", "r_raw"), ("d_an", "r_an"), "block", "year"))


_WITHIN_M = """
w AS (SELECT *, sif - avg(sif) OVER (PARTITION BY pixel, month) AS sif_w, o3 - avg(o3) OVER (PARTITION BY pixel, month) AS o3_w, t2m - avg(t2m) OVER (PARTITION BY pixel, month) AS t2m_w
 FROM (SELECT *, count(*) OVER (PARTITION BY pixel, month) AS group_size FROM f) WHERE group_size >= 5)"""
_WITHIN_Y = """
w AS (SELECT *, sif - avg(sif) OVER (PARTITION BY pixel, year) AS sif_w, o3 - avg(o3) OVER (PARTITION BY pixel, year) AS o3_w, t2m - avg(t2m) OVER (PARTITION BY pixel, year) AS t2m_w
 FROM (SELECT *, count(*) OVER (PARTITION BY pixel, year) AS group_size FROM f) WHERE group_size >= 6)"""
_W = {"d": "o3_w", "r": "sif_w"}


def future_exposure_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.future_exposure(supplier_rows(spark, sf_dir), "o3").select("pixel", "year", "month", "o3", "o3_next"))


def placebo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.future_exposure(supplier_rows(spark, sf_dir), "o3")
    return crossfit.oof_residuals(rows, "o3", "sif", ["t2m"], strata=["year"], more={"e": "o3_next"})


_NEXT = "fn AS (SELECT f.*, q.o3 AS o3_next FROM f JOIN f q ON f.pixel = q.pixel AND f.month = q.month AND f.year = q.year - 1)"
_PLACEBO = f"{supplier_sql()}, {_NEXT}, {oof_sql('o', 'fn', ['year'], targets={'d': 'o3', 'r': 'sif', 'e': 'o3_next'})}"


def placebo_joint_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.joint_effects(placebo_rows(spark, sf_dir), ["d", "e"], "r", "block", "year")
    return rounded(out.select("exposure", "theta", "se", "g1", "g2", "g12"))


def collinearity_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.collinearity(placebo_rows(spark, sf_dir), "d", "e"))


def residual_support_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.residual_support(kept(yearly_residuals(spark, sf_dir).select("year", "d"), "residuals"), ["year"]), 5)


def timefold_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.calibration(full_period_rows(spark, sf_dir), "o3", "sif"), 5, num=2, den=2, score_sum=3)


def timefold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.calibration_summary(diagnostics.calibration(full_period_rows(spark, sf_dir), "o3", "sif")), 5)


def combined_moments_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = yearly_residuals(spark, sf_dir).groupBy("tfold", "year").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return rounded(diagnostics.combined_moments(yearly, ["tfold"], "n", "mean", "sd"))


def effect_linear_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.linear_trend(yearly_components(spark, sf_dir)), 5)


def linear_trend_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effect_linear_trend(spark, sf_dir).select("test", "estimate", "se", "t_df")


def score_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score_cells(class_components(spark, sf_dir), "class", ["block", "year"]), 4)


def pairwise_class_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.pair_covariances(class_components(spark, sf_dir), "class").select("s", "t", "theta_s", "theta_t", "cov"))


def heterogeneity_omnibus(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, _ = inference.heterogeneity(class_components(spark, sf_dir), "class")
    return spark.createDataFrame([tuple(map(float, test.values()))], "f double, df1 double, df2 double, p double")


def heterogeneity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(inference.heterogeneity(class_components(spark, sf_dir), "class")[1], "first long, second long, difference double, se double, p_t double, p_holm double")


def threshold_repool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(inference.repooled(class_components(spark, sf_dir), "class", [20, 60, 100], ["class", "year"]), "class", "threshold")


def threshold_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By class: how far effects at other thresholds lie from the one at 20 rows, and whether signs agree."""
    t = inference.repooled(class_components(spark, sf_dir), "class", [20, 60, 100], ["class", "year"])
    ref = t.where("threshold = 20").select("class", F.col("theta").alias("ref"))
    m = t.join(ref, "class", "left").withColumn("gap", F.abs(F.col("theta") - F.col("ref")))
    out = m.groupBy("class").agg(F.count("*").alias("n_thresholds"), F.max("gap").alias("max_gap"), F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.bool_and(F.signum("theta") == F.signum("ref")).alias("same_sign"))
    return rounded(out)


def wild_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bootstrap.wild_month(yearly_components(spark, sf_dir, "year", "block", "month"), ["year"]))


def wild_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bootstrap.wild_year(yearly_components(spark, sf_dir)))


def wild_year_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bootstrap.wild_year(class_components(spark, sf_dir), ["class"]))


def climate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = yearly_residuals(spark, sf_dir)
    return climate.supported(components(rows, ["pixel", "block", "year", "month"], t2m=F.avg("t2m")), months=climate.MONTHS, least_years=5)


def climatology_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(climate.climatology_support(components(yearly_residuals(spark, sf_dir), ["pixel", "year", "month"], t2m=F.avg("t2m")), least_years=5))


def climate_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(climate.gram(climate_components(spark, sf_dir), ["year"]), 3)


def climate_weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(climate.weighted_moments(climate_components(spark, sf_dir)))


def climate_modifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(climate.modifier(climate_components(spark, sf_dir)))


def climate_modifier_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows from sums alone: estimates, errors of each kind and t tests, without the multiplier draws."""
    out = climate_modifier(spark, sf_dir)
    return rounded(out.select("parameter", "estimate", "covariance", "se_year", "se_block", "t_df", "p_t"), 5)


def gbt_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees (boosted.SETTING): metrics of both stages over the full period, a row a fold."""
    rows = crossfit.gbt_residuals(supplier_rows(spark, sf_dir), "o3", "sif", ["t2m", "ssrd", "x", "y"], Split("spatial", panels.FOLDS))
    return diagnostics.staged_metrics(rows, {"exposure": "o3", "outcome": "sif"}, ["fold"])


_ROUND_FEATURES, _ROUND_TARGETS = ["t2m", "ssrd", "x", "y"], ["o3", "sif"]


def boosted_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stump of every test fold and target: feature, bound, and the predictions on both sides."""
    rows = rounded(supplier_rows(spark, sf_dir)).withColumns({"_code": F.lit(0), "_cell": F.col("fold")})
    folds = range(panels.FOLDS)
    plan = [boosted.Model(i, np.array([f != s for f in folds]), {"trees": 1, "depth": 1}) for s in folds for i in range(2)]
    found = []
    for _, entries, group in boosted.grown(rows, _ROUND_FEATURES, _ROUND_TARGETS, plan):
        hats, tree = group._hats(), group.trees[0]
        for k, e in enumerate(entries):
            low, unit = hats.units[plan[e].target]
            f = int(tree.feature[k, 0])
            sides = [low + (int(hats.base[k]) + int(v)) * unit for v in tree.leaf[k]]
            found.append((e // 2, _ROUND_TARGETS[e % 2], _ROUND_FEATURES[f] if f >= 0 else None, float(hats.cuts[f][tree.cut[k, 0]]) if f >= 0 else None, sides[0], sides[1] if f >= 0 else None))
    return rounded(spark.createDataFrame(found, "test int, target string, feature string, below double, left_hat double, right_hat double"))


_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in (*_ROUND_FEATURES, *_ROUND_TARGETS))
_SCORE = "power({g}::DOUBLE, 2) / ({n} + 1.0)"
_BOOSTED = f"""
rr AS MATERIALIZED (SELECT fold, {_ROUNDED} FROM f),
sz AS (SELECT target, count(*) AS n, min(v) AS low, power(2.0, ceil(log2(max(v) - min(v)))) / power(2.0, least(36, 61 - ceil(log2(count(*) + 1)))) AS unit FROM (UNPIVOT rr ON {', '.join(_ROUND_TARGETS)} INTO NAME target VALUE v) GROUP BY target),
yy AS MATERIALIZED (SELECT fold, target, {', '.join(_ROUND_FEATURES)}, CAST(floor((v - low) / unit + 0.5) AS BIGINT) AS v FROM (UNPIVOT rr ON {', '.join(_ROUND_TARGETS)} INTO NAME target VALUE v) JOIN sz USING (target)),
ss AS (SELECT list_position({_ROUND_FEATURES}, feature) AS pos, feature, list_sort(list(x)) AS s FROM (UNPIVOT rr ON {', '.join(_ROUND_FEATURES)} INTO NAME feature VALUE x) GROUP BY feature),
ee AS (SELECT DISTINCT pos, feature, s[CAST(floor(i / 64.0 * (len(s) - 1)) AS BIGINT) + 1] AS edge FROM ss, (SELECT unnest(range(1, 64)) AS i)),
tt AS MATERIALIZED (SELECT test, target, yy.* EXCLUDE (target), CAST(floor(sum(v) OVER (PARTITION BY test, target) / count(*) OVER (PARTITION BY test, target)) AS BIGINT) - v AS g FROM yy, (SELECT unnest(range({panels.FOLDS})) AS test) WHERE fold <> test),
tot AS (SELECT test, target, sum(g) AS g, count(*) AS n, any_value(g + v) AS base FROM tt GROUP BY test, target),
cc AS (SELECT test, target, pos, ee.feature, edge, sum(g) AS gl, count(*) AS nl FROM (UNPIVOT tt ON {', '.join(_ROUND_FEATURES)} INTO NAME feature VALUE val) u JOIN ee ON u.feature = ee.feature AND val < edge GROUP BY ALL),
gg AS (SELECT c.*, t.g, t.n, base, {_SCORE.format(g='gl', n='nl')} + {_SCORE.format(g='(t.g - gl)', n='(t.n - nl)')} - {_SCORE.format(g='t.g', n='t.n')} AS gain FROM cc c JOIN tot t USING (test, target) WHERE nl < t.n),
best AS (SELECT * FROM gg WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY test, target ORDER BY gain DESC, pos, edge) = 1)
SELECT CAST(test AS INT) AS test, target, feature, round(edge, 6) AS below, round(low + (base + floor(0.1 * (-gl::DOUBLE) / (nl + 1.0) + 0.5)) * unit, 6) AS left_hat, round(low + (base + floor(0.1 * (-(b.g - gl)::DOUBLE) / (b.n - nl + 1.0) + 0.5)) * unit, 6) AS right_hat
FROM best b JOIN sz USING (target)
"""


def tuning_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tuning.ridge_search(supplier_rows(spark, sf_dir), "sif", ["t2m"], [0.0, 0.5]))


def tuning_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tuning.best(tuning.ridge_search(supplier_rows(spark, sf_dir), "sif", ["t2m"], [0.0, 0.5])))


QUERIES = {f.__name__: f for f in (
    effect_pooled, effect_by_year, effect_by_year_t, effect_pooled_signs, effect_month_signs, effect_month_cells, effect_by_month, effect_by_class, effect_block_scale, effect_control_sets, effect_wide_controls, effect_full_period_2d,
    effect_strict_fe, effect_interannual, oof_residuals_year, oof_metrics_by_year, components_block_year, within_pixel_year_panel, within_audit, paired_contrast, future_exposure_join, placebo_joint_effects,
    collinearity_diagnostics, residual_support_by_year, timefold_calibration, timefold_summary, combined_moments_by_fold, effect_linear_trend, linear_trend_estimate, score_matrix_pivot, pairwise_class_contrasts,
    heterogeneity_omnibus, heterogeneity_pairs, threshold_repool, threshold_stability, wild_month, wild_year, wild_year_by_class, climatology_support, climate_gram, climate_weighted_moments, climate_modifier, climate_modifier_estimate, gbt_residuals, boosted_round, month_heatmap, class_heatmap, tuning_search, tuning_best,
)}

# ---------------------------------------------------------------- SQL

_BY = f"{components_sql('c', 'o', ['block', 'year'])}, {two_way_sql('e', 'c', [], 'block', 'year')}"
_CAL = """
tot AS (SELECT sum(d * r) / sum(d * d) AS theta FROM o),
per AS (SELECT tfold, min(year) AS year_min, max(year) AS year_max, count(*) AS n,
 1 - sum((o3 - o3_hat) ** 2) / (var_pop(o3) * count(*)) AS exposure_r2, sqrt(avg(d * d)) AS exposure_rmse, avg(abs(d)) AS exposure_mae, avg(d) AS exposure_residual_mean, stddev_samp(d) AS exposure_residual_sd,
 1 - sum((sif - sif_hat) ** 2) / (var_pop(sif) * count(*)) AS outcome_r2, sqrt(avg(r * r)) AS outcome_rmse, avg(abs(r)) AS outcome_mae, avg(r) AS outcome_residual_mean, stddev_samp(r) AS outcome_residual_sd,
 sum(d * r) AS num, sum(d * d) AS den, sum(d * (r - theta * d)) AS score_sum, sum(abs(d * (r - theta * d))) AS score_abs FROM o, tot GROUP BY tfold),
cal AS (SELECT tfold + 1 AS time_fold, * EXCLUDE (tfold), abs(exposure_residual_mean) / exposure_residual_sd AS exposure_bias_over_sd, abs(outcome_residual_mean) / outcome_residual_sd AS outcome_bias_over_sd,
 den / n AS den_per_row, den / sum(den) OVER () AS information_share, num / den * 10 AS local_effect, score_abs / sum(score_abs) OVER () AS score_share FROM per)"""
_COLS5 = "exposure_r2 exposure_rmse exposure_mae exposure_residual_mean exposure_residual_sd outcome_r2 outcome_rmse outcome_mae outcome_residual_mean outcome_residual_sd exposure_bias_over_sd outcome_bias_over_sd den_per_row information_share local_effect score_share".split()


def _tuned(penalty: float) -> str:
    """Blocked ridge on one control by closed form."""
    return f"""SELECT {penalty}::DOUBLE AS penalty, avg(rmse) AS rmse_mean, coalesce(stddev_samp(rmse), 0) AS rmse_std, avg(mae) AS mae_mean, avg(r2) AS r2_mean, count(*) AS n_folds FROM (
 SELECT test, sqrt(avg((sif - h) ** 2)) AS rmse, avg(abs(sif - h)) AS mae, 1 - sum((sif - h) ** 2) / (var_pop(sif) * count(*)) AS r2 FROM (
  SELECT f.sif, test, (my - b * mc) + b * t2m AS h FROM f JOIN (SELECT test, avg(t2m) AS mc, avg(sif) AS my, (sum(t2m * sif) - count(*) * avg(t2m) * avg(sif)) / (sum(t2m * t2m) - count(*) * avg(t2m) ** 2 + {penalty} * count(*)) AS b
   FROM f, (SELECT unnest(range(5)) AS test) a WHERE fold <> test AND tfold <> test GROUP BY test) m ON f.fold = test OR f.tfold = test) GROUP BY test)"""


_TUNED = f"tuned AS ({_tuned(0.0)} UNION ALL {_tuned(0.5)})"
_TUNED_COLS = "penalty, round(rmse_mean, 6) AS rmse_mean, round(rmse_std, 6) AS rmse_std, round(mae_mean, 6) AS mae_mean, round(r2_mean, 6) AS r2_mean, n_folds"
_CLIM = f"""{_YEARLY}, cc AS (SELECT pixel, block, year, month, sum(d * r) AS num, sum(d * d) AS den, count(*) AS n, avg(t2m) AS t2m FROM o GROUP BY ALL),
cl AS (SELECT *, t2m - avg(t2m) OVER w AS a, count(*) OVER w AS years FROM cc WHERE month BETWEEN 4 AND 9 WINDOW w AS (PARTITION BY pixel, month)), cs AS (SELECT * FROM cl WHERE years >= 5 AND den > 0)"""


def _pair_parts() -> str:
    parts = []
    for keys, g, sign in ((["block"], "gb", ""), (["year"], "gy", ""), (["block", "year"], "gx", "-")):
        k = ", ".join(keys)
        one = f"(SELECT class, {k}, sum(v) AS v FROM sv GROUP BY class, {k})"
        parts.append(f"SELECT a.class AS s, b.class AS t, {sign}sum(a.v * b.v) * any_value({g} / ({g} - 1.0)) AS m FROM {one} a JOIN {one} b USING ({k}) CROSS JOIN gg WHERE a.class <= b.class GROUP BY a.class, b.class")
    return " UNION ALL ".join(parts)


_SLOPE = f"""WITH {_YEARLY}, {components_sql('c', 'o', ['block', 'year'])}, yc AS (SELECT avg(year) AS m FROM (SELECT DISTINCT year FROM c)), z AS (SELECT block, year, num, den, year - m AS t FROM c, yc),
 h AS (SELECT sum(den) AS a, sum(den * t) AS b, sum(den * t * t) AS c, sum(num) AS u, sum(num * t) AS v FROM z), k AS (SELECT *, (c * u - b * v) / (a * c - b * b) AS t0, (a * v - b * u) / (a * c - b * b) AS t1, a * c - b * b AS det FROM h),
 s AS (SELECT block, year, num - den * (t0 + t1 * t) AS s1, t * (num - den * (t0 + t1 * t)) AS s2 FROM z, k),
 mb AS (SELECT count(*) AS g, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM (SELECT sum(s1) AS x, sum(s2) AS y FROM s GROUP BY block)), my AS (SELECT count(*) AS g, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM (SELECT sum(s1) AS x, sum(s2) AS y FROM s GROUP BY year)), mx AS (SELECT count(*) AS g, sum(s1 * s1) AS xx, sum(s1 * s2) AS xy, sum(s2 * s2) AS yy FROM s),
 m AS (SELECT mb.g AS g1, my.g AS g2, mb.xx * mb.g / (mb.g - 1.0) + my.xx * my.g / (my.g - 1.0) - mx.xx * mx.g / (mx.g - 1.0) AS xx, mb.xy * mb.g / (mb.g - 1.0) + my.xy * my.g / (my.g - 1.0) - mx.xy * mx.g / (mx.g - 1.0) AS xy, mb.yy * mb.g / (mb.g - 1.0) + my.yy * my.g / (my.g - 1.0) - mx.yy * mx.g / (mx.g - 1.0) AS yy FROM mb, my, mx),
 q AS (SELECT *, (c * c * xx - 2 * b * c * xy + b * b * yy) / (det * det) AS p, (b * b * xx - 2 * a * b * xy + a * a * yy) / (det * det) AS w, (-b * c * xx + (a * c + b * b) * xy - a * b * yy) / (det * det) AS zz FROM k, m),
 l AS (SELECT *, (p + w) / 2 + sqrt(((p - w) / 2) ** 2 + zz * zz) AS l1, (p + w) / 2 - sqrt(((p - w) / 2) ** 2 + zz * zz) AS l2 FROM q)
 SELECT 'linear_trend_per_year' AS test, t1 * 10 AS estimate, 10 * sqrt(CASE WHEN l2 >= 0 THEN w WHEN l1 <= 0 THEN 0 ELSE l1 * (w - l2) / (l1 - l2) END) AS se, CAST(greatest(1, least(g1, g2) - 1) AS INT) AS t_df FROM l"""
_TESTS = f"""te AS (SELECT e.*, CAST(greatest(least(g1, g2) - 1, 1) AS INT) AS t_df, theta / se AS z FROM e), tp AS (SELECT te.*, c AS crit, {normal_p_sql('z')} AS p_normal, {t_p_sql('z', 't_df')} AS p_t FROM te JOIN crit ON df = t_df)"""
_TESTED = "t_df, round(theta * 10, 6) AS effect, round(se * 10, 6) AS effect_se, round((theta - 1.96 * se) * 10, 6) AS ci_normal_low, round((theta + 1.96 * se) * 10, 6) AS ci_normal_high, round((theta - crit * se) * 10, 6) AS ci_t_low, round((theta + crit * se) * 10, 6) AS ci_t_high, round(p_normal, 6) AS p_normal, round(p_t, 6) AS p_t"


def _signs(keys: str) -> str:
    """CTE sg: yearly effects counted by sign."""
    return f"ye AS (SELECT {keys}, year, sum(num) / sum(den) AS theta FROM c GROUP BY {keys}, year), sn AS (SELECT {keys}, count(*) AS n_years, count(*) FILTER (WHERE theta < 0) AS n_negative, median(theta) AS median_effect FROM ye GROUP BY {keys}), sg AS (SELECT *, {sign_p_sql('n_negative', 'n_years')} AS sign_p FROM sn)"


_SIGNS = "n_years, n_negative, round(median_effect, 6) AS median_effect, round(sign_p, 6) AS sign_p"


def _modifier() -> str:
    """Month intercepts and one slope by partialling out; a parameter's influence is the same combination of the scores."""
    parts = []
    for keys in ("block", "year"):
        parts.append(f"""{keys}_u AS (SELECT {keys}, month, sum(q1) AS q1, sum(q2) AS q2 FROM sc GROUP BY {keys}, month),
{keys}_g AS (SELECT {keys}, sum(q2 - sa / s * q1) / any_value(dd) AS i FROM {keys}_u JOIN mo USING (month), de GROUP BY {keys}),
{keys}_m AS (SELECT mo.month, sum((coalesce(q1, 0) / s - sa / s * i) ** 2) * count(*) / (count(*) - 1.0) AS v FROM mo CROSS JOIN {keys}_g LEFT JOIN {keys}_u USING ({keys}, month) GROUP BY mo.month UNION ALL SELECT 99, sum(i * i) * count(*) / (count(*) - 1.0) FROM {keys}_g)""")
    return ", ".join(parts)


_CMOD = f"""{_CLIM}, gr AS (SELECT block, year, month, sum(den) AS s, sum(den * a) AS sa, sum(den * a * a) AS saa, sum(num) AS u, sum(num * a) AS ua FROM cs GROUP BY block, year, month),
mo AS (SELECT month, sum(s) AS s, sum(sa) AS sa, sum(saa) AS saa, sum(u) AS u, sum(ua) AS ua FROM gr GROUP BY month), de AS (SELECT sum(saa - sa * sa / s) AS dd, sum(ua - u * sa / s) / sum(saa - sa * sa / s) AS gamma FROM mo),
be AS (SELECT month, (u - gamma * sa) / s AS b FROM mo, de UNION ALL SELECT 99, gamma FROM de),
sc AS (SELECT block, year, gr.month, u - s * b - sa * gamma AS q1, ua - sa * b - saa * gamma AS q2 FROM gr JOIN be USING (month), de), {_modifier()}"""
_WEBB = "[" + ", ".join(map(repr, bootstrap.WEBB.tolist())) + "]::DOUBLE[]"


def _lot(key: str, cluster: str) -> str:
    return f"({_WEBB})[('0x' || substr(md5('{bootstrap.SEED}:' || {key} || ':' || r || ':' || {cluster}), 1, 7))::INT % 6 + 1]"


def _wild_year(key: str, label: str) -> str:
    """Resampled yearly sums of each stratum ``key``; c holds the components."""
    return f"""cy AS (SELECT {key} AS k, year, sum(num) AS num, sum(den) AS den FROM c GROUP BY {key}, year), hy AS (SELECT k, sum(num) / sum(den) AS theta, sum(den) AS den, count(*) AS g, CASE WHEN count(*) > 1 THEN count(*) / (count(*) - 1.0) ELSE 1.0 END AS f, abs(sum(num) / sqrt(CASE WHEN count(*) > 1 THEN count(*) / (count(*) - 1.0) ELSE 1.0 END * sum(num * num))) AS seen FROM cy GROUP BY k),
wy AS (SELECT k, r, {_lot('k', 'year')} AS w, cy.num, cy.num - theta * cy.den AS u, hy.den, f, seen FROM cy JOIN hy USING (k), range({bootstrap.REPS}) t(r)),
ry AS (SELECT k, r, sum(w * num) / sqrt(any_value(f) * sum(w * w * num * num)) AS t, any_value(seen) AS seen, sum(w * u) / any_value(den) AS delta FROM wy GROUP BY k, r),
qy AS (SELECT k, (1 + count(*) FILTER (WHERE abs(t) >= seen * (1 - 1e-9))) / {bootstrap.REPS + 1}.0 AS p, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM ry GROUP BY k)
SELECT {label}round(theta, 6) AS theta, round(p, 6) AS p_wild, round(theta - hi, 6) AS ci_low, round(theta - lo, 6) AS ci_high, g FROM qy JOIN hy USING (k)"""


#: Two-way errors of every repetition from sums over months: block products of scores, their products with block sums, and cell squares.
_WILD_MONTH = f"""{_YEARLY}, {components_sql('c', 'o', ['year', 'block', 'month'])}, h AS (SELECT year, sum(num) / sum(den) AS theta, sum(den) AS total, count(DISTINCT block) AS g1, count(DISTINCT month) AS g2, count(*) FILTER (WHERE den > 0) AS g12 FROM c GROUP BY year),
s AS (SELECT c.*, num - theta * den AS s FROM c JOIN h USING (year)), bd AS (SELECT year, block, sum(den) AS d FROM c GROUP BY year, block),
gm AS (SELECT a.year, a.month AS m, b.month AS n, sum(a.s * b.s) AS g FROM s a JOIN s b ON a.year = b.year AND a.block = b.block GROUP BY ALL),
mm AS (SELECT s.year, month AS m, sum(s) AS s, sum(den) AS d, sum(s * s) AS a, sum(s * den) AS b, sum(s * bd.d) AS hh FROM s JOIN bd USING (year, block) GROUP BY s.year, month),
kk AS (SELECT year, (SELECT sum(d * d) FROM bd WHERE bd.year = h.year) AS k, (SELECT sum(den * den) FROM c WHERE c.year = h.year) AS c2 FROM h),
w AS (SELECT year, m, r, {_lot('year', 'm')} AS w FROM mm, range({bootstrap.REPS}) t(r)),
one AS (SELECT year, r, sum(w * s) AS ws, sum(w * w * a) AS wa, sum(w * b) AS wb, sum(w * hh) AS wh, sum(w * w * s * s) AS wss, sum(w * s * d) AS wsd, sum(d * d) AS dd FROM w JOIN mm USING (year, m) GROUP BY year, r),
two AS (SELECT w1.year, w1.r, sum(w1.w * w2.w * g) AS wg FROM w w1 JOIN gm ON gm.year = w1.year AND gm.m = w1.m JOIN w w2 ON w2.year = gm.year AND w2.m = gm.n AND w2.r = w1.r GROUP BY w1.year, w1.r),
fc AS (SELECT *, g1 / (g1 - 1.0) AS f1, g2 / (g2 - 1.0) AS f2, g12 / (g12 - 1.0) AS f12 FROM h JOIN kk USING (year)),
v AS (SELECT year, r, ws / total AS z, total, f1 * (wg - 2 * ws / total * wh + (ws / total) ** 2 * k) AS m1, f2 * (wss - 2 * ws / total * wsd + (ws / total) ** 2 * dd) AS m2, f12 * (wa - 2 * ws / total * wb + (ws / total) ** 2 * c2) AS m12 FROM one JOIN two USING (year, r) JOIN fc USING (year)),
seen AS (SELECT fc.year, theta, g1, g2, f1 * (SELECT sum(x * x) FROM (SELECT sum(s) AS x FROM s WHERE s.year = fc.year GROUP BY block)) AS m1, f2 * (SELECT sum(x * x) FROM (SELECT sum(s) AS x FROM s WHERE s.year = fc.year GROUP BY month)) AS m2, f12 * (SELECT sum(s * s) FROM s WHERE s.year = fc.year) AS m12, total FROM fc),
e AS (SELECT *, sqrt(CASE WHEN m1 + m2 - m12 > 0 THEN m1 + m2 - m12 ELSE greatest(m1, m2) END) / total AS se FROM seen),
t AS (SELECT v.year, abs(z / (sqrt(CASE WHEN v.m1 + v.m2 - v.m12 > 0 THEN v.m1 + v.m2 - v.m12 ELSE greatest(v.m1, v.m2) END) / v.total)) AS t, abs(theta / se) AS s FROM v JOIN e USING (year)),
q AS (SELECT year, quantile_cont(t, 0.95) AS critical, (1 + count(*) FILTER (WHERE t >= s * (1 - 1e-9))) / {bootstrap.REPS + 1}.0 AS p FROM t GROUP BY year)
SELECT year, round(theta, 6) AS theta, round(se, 6) AS se, round(critical, 6) AS critical, round(p, 6) AS p_wild, g1, g2 FROM e JOIN q USING (year)"""
_HEAT = ", ".join(f"max(CASE WHEN year = {y} THEN theta END) AS y{y}" for y in range(1995, 2002))
ORACLE_SQL = {
    "effect_pooled": f"WITH {_YEARLY}, {_BY} SELECT {_EFFECT} FROM e",
    "effect_by_year": f"WITH {_YEARLY}, {components_sql('c', 'o', ['year', 'block', 'month'])}, {two_way_sql('e', 'c', ['year'], 'block', 'month')} SELECT year, {_EFFECT} FROM e",
    "effect_month_cells": f"""WITH {supplier_sql()}, {oof_sql('o', 'f', ['year', 'month'])}, {components_sql('c', 'o', ['year', 'month', 'block'])},
 h AS (SELECT year, month, sum(num) / sum(den) AS theta, sum(den) AS den, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY year, month)
 SELECT year, month, round(any_value(theta), 5) AS theta, round(sqrt(sum((c.num - theta * c.den) ** 2) * CASE WHEN count(*) > 1 THEN count(*) / (count(*) - 1.0) ELSE 1.0 END) / any_value(h.den), 5) AS se, count(*) AS g1, any_value(h.n) AS n FROM c JOIN h USING (year, month) GROUP BY year, month""",
    "effect_by_month": f"WITH {supplier_sql()}, {oof_sql('o', 'f', ['year', 'month'])}, {components_sql('c', 'o', ['month', 'year', 'block'])}, {two_way_sql('e', 'c', ['month'], 'block', 'year')} SELECT month, {_EFFECT} FROM e",
    "effect_by_class": f"WITH {_CLASSES}, {two_way_sql('e', 'c', ['class'], 'block', 'year')} SELECT class, {_EFFECT} FROM e",
    "effect_block_scale": " UNION ALL ".join(f"(WITH {supplier_sql(k)}, {oof_sql('o', 'f', ['year'])}, {_BY} SELECT {k} AS factor, {_EFFECT} FROM e)" for k in (1, 2, 4)),
    "effect_control_sets": " UNION ALL ".join(f"(WITH {supplier_sql()}, fx AS (SELECT * FROM f WHERE tp IS NOT NULL), {oof_sql('o', 'fx', ['year'], c)}, {_BY} SELECT '{c}' AS control, {_EFFECT} FROM e)" for c in ("t2m", "ssrd", "tp")),
    "effect_full_period_2d": f"WITH {_FULL}, {components_sql('c', 'o', ['block', 'year'])}, {two_way_sql('e', 'c', [], 'block', 'year', small=False)} SELECT {_EFFECT} FROM e",
    "effect_strict_fe": f"WITH {supplier_sql()}, {_WITHIN_Y}, {oof_sql('o', 'w', ['year'], 't2m_w', _W)}, {_BY} SELECT {_EFFECT} FROM e",
    "effect_interannual": f"WITH {supplier_sql()}, {_WITHIN_M}, {oof_sql('o', 'w', [], 't2m_w', _W)}, {_BY} SELECT {_EFFECT} FROM e",
    "oof_residuals_year": f"WITH {_YEARLY} SELECT pixel, year, month, fold, round(d, 6) AS d, round(r, 6) AS r FROM o",
    "oof_metrics_by_year": f"WITH {_YEARLY}, s AS (SELECT year, 'exposure' AS stage, o3 AS y, o3_hat AS p FROM o UNION ALL SELECT year, 'outcome', sif, sif_hat FROM o) SELECT year, stage, count(*) AS n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(avg(y - p), 6) AS bias, round(avg(y), 6) AS target_mean, round(avg(p), 6) AS prediction_mean FROM s GROUP BY year, stage",
    "components_block_year": f"WITH {_YEARLY}, {components_sql('c', 'o', ['block', 'year'])} SELECT block, year, round(num, 4) AS num, round(den, 4) AS den, n FROM c",
    "within_pixel_year_panel": f"WITH {supplier_sql()}, {_WITHIN_Y} SELECT pixel, year, month, group_size, round(sif_w, 8) AS sif_w, round(o3_w, 8) AS o3_w, round(t2m_w, 8) AS t2m_w FROM w",
    "within_audit": f"WITH {supplier_sql()}, {_WITHIN_M}, g AS (SELECT pixel, month, abs(avg(sif_w)) AS a, abs(avg(o3_w)) AS b FROM w GROUP BY pixel, month) SELECT 'sif' AS variable, round(max(a), 9) AS max_abs_mean, round(avg(a), 9) AS mean_abs_mean, count(*) AS n_groups FROM g UNION ALL SELECT 'o3', round(max(b), 9), round(avg(b), 9), count(*) FROM g",
    "paired_contrast": f"""WITH {supplier_sql()}, {_WITHIN_M}, {oof_sql('a', 'w', [])}, w2 AS (SELECT * EXCLUDE (d, r, o3_hat, sif_hat), d AS d1, r AS r1 FROM a), {oof_sql('o', 'w2', [], 't2m_w', _W)},
 t AS (SELECT sum(d1 * r1) / sum(d1 * d1) AS t1, sum(d1 * d1) AS v1, sum(d * r) / sum(d * d) AS t2, sum(d * d) AS v2 FROM o),
 i AS (SELECT block, year, d1 * (r1 - t1 * d1) / v1 - d * (r - t2 * d) / v2 AS i FROM o, t),
 b AS (SELECT sum(s * s) AS m, count(*) AS g FROM (SELECT sum(i) AS s FROM i GROUP BY block)), y AS (SELECT sum(s * s) AS m, count(*) AS g FROM (SELECT sum(i) AS s FROM i GROUP BY year)), x AS (SELECT sum(s * s) AS m, count(*) AS g FROM (SELECT sum(i) AS s FROM i GROUP BY block, year)),
 v AS (SELECT b.m * b.g / (b.g - 1.0) AS vb, y.m * y.g / (y.g - 1.0) AS vy, x.m * x.g / (x.g - 1.0) AS vx, b.g AS g1, y.g AS g2, x.g AS g12 FROM b, y, x)
 SELECT round(t1, 6) AS theta_first, round(t2, 6) AS theta_second, round(t1 - t2, 6) AS difference, round(sqrt(CASE WHEN vb + vy - vx > 0 THEN vb + vy - vx ELSE greatest(vb, vy) END), 6) AS se, NOT (vb + vy - vx > 0) AS fallback, g1, g2, g12 FROM t, v""",
    "future_exposure_join": f"WITH {supplier_sql()}, {_NEXT} SELECT pixel, year, month, round(o3, 6) AS o3, round(o3_next, 6) AS o3_next FROM fn",
    "collinearity_diagnostics": f"WITH {_PLACEBO}, c AS (SELECT count(*) AS n, corr(d, e) AS r FROM o) SELECT n, round(r, 6) AS correlation, round(1 / greatest(1e-12, 1 - r * r), 6) AS vif, round((1 + abs(r)) / (1 - abs(r)), 6) AS condition FROM c",
    "placebo_joint_effects": f"""WITH {_PLACEBO}, h AS (SELECT sum(d * d) AS a, sum(d * e) AS b, sum(e * e) AS c, sum(d * r) AS u, sum(e * r) AS v FROM o),
 k AS (SELECT *, (c * u - b * v) / (a * c - b * b) AS t1, (a * v - b * u) / (a * c - b * b) AS t2, a * c - b * b AS det FROM h),
 s AS (SELECT block, year, sum(d * (r - t1 * d - t2 * e)) AS s1, sum(e * (r - t1 * d - t2 * e)) AS s2 FROM o, k GROUP BY block, year),
 mb AS (SELECT count(*) AS g, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM (SELECT sum(s1) AS x, sum(s2) AS y FROM s GROUP BY block)), my AS (SELECT count(*) AS g, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM (SELECT sum(s1) AS x, sum(s2) AS y FROM s GROUP BY year)), mx AS (SELECT count(*) AS g, sum(s1 * s1) AS xx, sum(s1 * s2) AS xy, sum(s2 * s2) AS yy FROM s),
 m AS (SELECT mb.g AS g1, my.g AS g2, mx.g AS g12, mb.xx * mb.g / (mb.g - 1.0) + my.xx * my.g / (my.g - 1.0) - mx.xx * mx.g / (mx.g - 1.0) AS xx, mb.xy * mb.g / (mb.g - 1.0) + my.xy * my.g / (my.g - 1.0) - mx.xy * mx.g / (mx.g - 1.0) AS xy, mb.yy * mb.g / (mb.g - 1.0) + my.yy * my.g / (my.g - 1.0) - mx.yy * mx.g / (mx.g - 1.0) AS yy FROM mb, my, mx),
 q AS (SELECT *, (c * c * xx - 2 * b * c * xy + b * b * yy) / (det * det) AS p, (b * b * xx - 2 * a * b * xy + a * a * yy) / (det * det) AS w, (-b * c * xx + (a * c + b * b) * xy - a * b * yy) / (det * det) AS z FROM k, m),
 l AS (SELECT *, (p + w) / 2 + sqrt(((p - w) / 2) ** 2 + z * z) AS l1, (p + w) / 2 - sqrt(((p - w) / 2) ** 2 + z * z) AS l2 FROM q),
 r AS (SELECT *, CASE WHEN l2 >= 0 THEN p WHEN l1 <= 0 THEN 0 ELSE l1 * (p - l2) / (l1 - l2) END AS v1, CASE WHEN l2 >= 0 THEN w WHEN l1 <= 0 THEN 0 ELSE l1 * (w - l2) / (l1 - l2) END AS v2 FROM l)
 SELECT 'd' AS exposure, round(t1, 6) AS theta, round(sqrt(v1), 6) AS se, g1, g2, g12 FROM r UNION ALL SELECT 'e', round(t2, 6), round(sqrt(v2), 6), g1, g2, g12 FROM r""",
    "residual_support_by_year": f"""WITH {_YEARLY}, c AS (SELECT year, quantile_cont(abs(d), 0.95) AS c5, quantile_cont(abs(d), 0.99) AS c1 FROM o GROUP BY year)
 SELECT year, count(*) AS n, round(avg(d), 5) AS residual_mean, round(stddev_samp(d), 5) AS residual_sd, round(quantile_cont(d, 0.01), 5) AS q01, round(quantile_cont(d, 0.05), 5) AS q05, round(quantile_cont(d, 0.5), 5) AS q50, round(quantile_cont(d, 0.95), 5) AS q95, round(quantile_cont(d, 0.99), 5) AS q99,
 round(sum(d * d), 5) AS den, round(sum(d * d) / count(*), 5) AS den_per_row, round(sum(d * d) FILTER (WHERE abs(d) >= c5) / sum(d * d), 5) AS top5_share, round(sum(d * d) FILTER (WHERE abs(d) >= c1) / sum(d * d), 5) AS top1_share FROM o JOIN c USING (year) GROUP BY year""",
    "timefold_calibration": f"WITH {_FULL}, {_CAL} SELECT time_fold, year_min, year_max, n, {', '.join(f'round({c}, 5) AS {c}' for c in _COLS5)}, round(num, 2) AS num, round(den, 2) AS den, round(score_sum, 3) AS score_sum FROM cal",
    "timefold_summary": f"""WITH {_FULL}, {_CAL} SELECT count(*) AS n_folds, round(sum(information_share) FILTER (WHERE time_fold > (SELECT max(time_fold) FROM cal) - 2), 5) AS late_share, round(max(abs(exposure_residual_mean)), 5) AS max_exposure_bias, round(max(exposure_bias_over_sd), 5) AS max_exposure_bias_over_sd,
 round(max(abs(outcome_residual_mean)), 5) AS max_outcome_bias, round(max(outcome_bias_over_sd), 5) AS max_outcome_bias_over_sd, round(min(exposure_r2), 5) AS min_exposure_r2, round(min(outcome_r2), 5) AS min_outcome_r2, round(min(local_effect), 5) AS effect_min, round(max(local_effect), 5) AS effect_max FROM cal""",
    "combined_moments_by_fold": f"WITH {_YEARLY} SELECT tfold, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd FROM o GROUP BY tfold",
    "linear_trend_estimate": f"SELECT test, round(estimate, 5) AS estimate, round(se, 5) AS se, t_df FROM ({_SLOPE})",
    "effect_linear_trend": f"WITH RECURSIVE {critical_sql()}, a AS ({_SLOPE}), b AS (SELECT *, estimate / se AS z FROM a JOIN crit ON df = t_df) SELECT test, round(estimate, 5) AS estimate, round(se, 5) AS se, round({t_p_sql('z', 't_df')}, 5) AS p_t, round(estimate - c * se, 5) AS ci_low, round(estimate + c * se, 5) AS ci_high, t_df FROM b",
    "score_matrix_pivot": f"""WITH {_CLASSES}, h AS (SELECT class, sum(num) / sum(den) AS theta FROM c GROUP BY class), s AS (SELECT block, year, class, sum(num - theta * den) AS s FROM c JOIN h USING (class) GROUP BY ALL)
 SELECT block, year, {', '.join(f'round(coalesce(sum(s) FILTER (WHERE class = {k}), 0), 4) AS "{k}"' for k in (10, 50, 60, 70, 90, 120, 130))} FROM s GROUP BY block, year""",
    "pairwise_class_contrasts": f"""WITH {_CLASSES}, h AS (SELECT class, sum(num) / sum(den) AS theta, sum(den) AS total FROM c GROUP BY class), sv AS (SELECT class, block, year, (num - theta * den) / total AS v FROM c JOIN h USING (class)),
 gg AS (SELECT count(DISTINCT block) AS gb, count(DISTINCT year) AS gy, count(DISTINCT (block, year)) AS gx FROM c), pp AS ({_pair_parts()}), pm AS (SELECT s, t, sum(m) AS cov FROM pp GROUP BY s, t)
 SELECT s, t, round(a.theta, 6) AS theta_s, round(b.theta, 6) AS theta_t, round(cov, 6) AS cov FROM pm JOIN h a ON a.class = s JOIN h b ON b.class = t""",
    "threshold_repool": f"WITH {_CLASSES}, sz AS (SELECT class, year, threshold FROM (SELECT class, year, sum(n) AS n FROM c GROUP BY class, year), (SELECT unnest([20, 60, 100]) AS threshold) WHERE n >= threshold), ct AS (SELECT c.*, threshold FROM c JOIN sz USING (class, year)), {two_way_sql('e', 'ct', ['class', 'threshold'], 'block', 'year')} SELECT class, threshold, {_EFFECT} FROM e",
    "threshold_stability": f"""WITH {_CLASSES}, sz AS (SELECT class, year, threshold FROM (SELECT class, year, sum(n) AS n FROM c GROUP BY class, year), (SELECT unnest([20, 60, 100]) AS threshold) WHERE n >= threshold), t AS (SELECT class, threshold, sum(num) / sum(den) AS theta FROM c JOIN sz USING (class, year) GROUP BY class, threshold),
 m AS (SELECT t.*, r.theta AS ref FROM t LEFT JOIN t r ON r.class = t.class AND r.threshold = 20) SELECT class, count(*) AS n_thresholds, round(max(abs(theta - ref)), 6) AS max_gap, round(quantile_cont(abs(theta - ref), 0.5), 6) AS median_gap, bool_and(sign(theta) = sign(ref)) AS same_sign FROM m GROUP BY class""",
    "climatology_support": f"WITH {_YEARLY}, y AS (SELECT pixel, month, count(*) AS years FROM (SELECT DISTINCT pixel, month, year FROM o) GROUP BY pixel, month) SELECT month, count(*) AS n_pixels, count(*) FILTER (WHERE years >= 5) AS n_supported, round(avg(years), 6) AS mean_years FROM y GROUP BY month",
    "climate_gram": f"WITH {_CLIM} SELECT year, month, round(sum(den), 3) AS s, round(sum(den * a), 3) AS sa, round(sum(den * a * a), 3) AS saa, round(sum(num), 3) AS u, round(sum(num * a), 3) AS ua FROM cs GROUP BY year, month",
    "climate_weighted_moments": f"WITH {_CLIM}, m AS (SELECT count(*) AS n, avg(a) AS mean, stddev_samp(a) AS sd, sum(den * a) / sum(den) AS wm, sum(den * a * a) / sum(den) AS wa FROM cs) SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(wm, 6) AS weighted_mean, round(sqrt(wa - wm * wm), 6) AS weighted_sd FROM m",
    "effect_by_year_t": f"WITH RECURSIVE {critical_sql()}, {_YEARLY}, {components_sql('c', 'o', ['year', 'block', 'month'])}, {two_way_sql('e', 'c', ['year'], 'block', 'month')}, {_TESTS}, rk AS (SELECT *, {ranked_sql('p_t')} FROM tp) SELECT year, {_TESTED}, round({q_sql('p_t')}, 6) AS q FROM rk",
    "effect_pooled_signs": f"WITH RECURSIVE {critical_sql()}, {_YEARLY}, {_BY}, {_TESTS}, {_signs('one').replace('FROM c', 'FROM (SELECT *, 1 AS one FROM c)')} SELECT {_TESTED}, {_SIGNS} FROM tp, sg",
    "effect_month_signs": f"WITH {supplier_sql()}, {oof_sql('o', 'f', ['year', 'month'])}, {components_sql('c', 'o', ['month', 'year', 'block'])}, {_signs('month')} SELECT month, {_SIGNS} FROM sg",
    "climate_modifier_estimate": f"""WITH {_CMOD}, g AS (SELECT count(DISTINCT block) AS gb, count(DISTINCT year) AS gy FROM gr), x_u AS (SELECT block, year, month, sum(q1) AS q1, sum(q2) AS q2 FROM sc GROUP BY ALL), x_g AS (SELECT block, year, sum(q2 - sa / s * q1) / any_value(dd) AS i FROM x_u JOIN mo USING (month), de GROUP BY block, year),
 x_m AS (SELECT mo.month, sum((coalesce(q1, 0) / s - sa / s * i) ** 2) * count(*) / (count(*) - 1.0) AS v FROM mo CROSS JOIN x_g LEFT JOIN x_u USING (block, year, month) GROUP BY mo.month UNION ALL SELECT 99, sum(i * i) * count(*) / (count(*) - 1.0) FROM x_g),
 va AS (SELECT month, b * 10 AS estimate, x.v AS vx, y.v AS vy, z.v AS vb, z.v + y.v - x.v AS v FROM be JOIN x_m x USING (month) JOIN year_m y USING (month) JOIN block_m z USING (month)), ok AS (SELECT min(v) > 0 AS valid FROM va),
 ta AS (SELECT va.*, valid, CAST(greatest(1, CASE WHEN valid THEN least(gb, gy) ELSE gy END - 1) AS INT) AS t_df, estimate / (10 * sqrt(CASE WHEN valid THEN v ELSE vy END)) AS z FROM va, ok, g)
 SELECT CASE WHEN month = 99 THEN 't2m_anomaly' ELSE 'month_' || lpad(CAST(month AS VARCHAR), 2, '0') END AS parameter, round(estimate, 5) AS estimate, CASE WHEN valid THEN 'two_way' ELSE 'year' END AS covariance, round(10 * sqrt(vy), 5) AS se_year, round(10 * sqrt(vb), 5) AS se_block, t_df, round({t_p_sql('z', 't_df')}, 5) AS p_t FROM ta""",
    "wild_year": f"WITH {_YEARLY}, {components_sql('c', 'o', ['block', 'year'])}, {_wild_year('(0 * year)', '')}",
    "wild_year_by_class": f"WITH {_CLASSES}, {_wild_year('class', 'k AS class, ')}",
    "wild_month": f"WITH {_WILD_MONTH}",
    "tuning_search": f"WITH {supplier_sql()}, {_TUNED} SELECT {_TUNED_COLS} FROM tuned",
    "class_heatmap": f"WITH {_CLASSES}, e AS (SELECT class, year, round(sum(num) / sum(den), 5) AS theta FROM c GROUP BY class, year) SELECT class, {_HEAT}, (SELECT max(abs(theta)) FROM e) AS reach FROM e GROUP BY class",
    "boosted_round": f"WITH {supplier_sql()}, {_BOOSTED}",
    "tuning_best": f"WITH {supplier_sql()}, {_TUNED} SELECT {_TUNED_COLS} FROM tuned ORDER BY rmse_mean, rmse_std, penalty LIMIT 1",
}
ORACLE_SQL["month_heatmap"] = f"WITH e AS ({ORACLE_SQL['effect_month_cells']}) SELECT CAST(m.month AS INT) AS month, {_HEAT}, (SELECT max(abs(theta)) FROM e) AS reach FROM range(1, 13) AS m(month) LEFT JOIN e ON e.month = m.month GROUP BY m.month"
