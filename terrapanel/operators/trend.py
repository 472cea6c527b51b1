"""Robust trends of each pixel's yearly series: Sen slope, Mann-Kendall with autocorrelation-adjusted variance.

A series is one value a year, so a pixel's series is a short array; arrays of one length are worked on as a matrix.
``sen_slopes`` and ``mann_kendall`` give the same slope and statistic with built-in functions on arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import normal_quantile, normal_sf2
from .multiplicity import fdr

OUT = "n int, sen_slope double, sen_intercept double, mk_z double, mk_p double, lag1 double, factor double, ols_slope double, ols_r2 double"


def yearly_means(panel: DataFrame, values: list[str], pixel: str = "pixel") -> DataFrame:
    return panel.groupBy(pixel, "year").agg(*(F.avg(v).alias(v) for v in values))


def least_years(n_years: int) -> int:
    return max(8, math.ceil(0.70 * n_years))


def _series(pixel: str, value: str) -> Column:
    return F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col("year").cast("double").alias("x"), F.col(value).cast("double").alias("y"))))).alias("s")


def _pairs(s: Column, f) -> Column:
    """f(earlier, later) over all pairs of a series."""
    return F.flatten(F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.greatest(F.size(s) - i - 1, F.lit(0))), lambda b: f(a, b))))


def _median(a: Column) -> Column:
    v, n = F.array_sort(a), F.size(a)
    return F.when(n > 0, (F.try_element_at(v, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(v, F.floor((n + 2) / 2).cast("int"))) / 2)


def sen_slopes(yearly: DataFrame, value: str, pixel: str = "pixel") -> DataFrame:
    """pixel, n, sen_slope (median slope over all pairs of years) and sen_intercept."""
    s = yearly.groupBy(pixel).agg(_series(pixel, value))
    s = s.withColumn("sen_slope", _median(F.filter(_pairs(F.col("s"), lambda a, b: F.when(b["x"] > a["x"], (b["y"] - a["y"]) / (b["x"] - a["x"]))), lambda v: v.isNotNull())))
    return s.select(pixel, F.size("s").alias("n"), "sen_slope", _median(F.transform("s", lambda p: p["y"] - F.col("sen_slope") * p["x"])).alias("sen_intercept"))


def mann_kendall(yearly: DataFrame, value: str, pixel: str = "pixel") -> DataFrame:
    """pixel, n, s and its tie-corrected variance (NULL below three years)."""
    s = yearly.groupBy(pixel).agg(_series(pixel, value))
    n = F.size("s").cast("double")
    y = F.transform("s", lambda p: p["y"])
    ties = F.aggregate(F.array_distinct(y), F.lit(0.0), lambda a, v: a + _tie(F.size(F.filter(y, lambda w: w == v)).cast("double")))
    enough = n >= 3
    return s.select(pixel, F.size("s").alias("n"), F.when(enough, F.aggregate(_pairs(F.col("s"), lambda a, b: F.signum(b["y"] - a["y"])), F.lit(0.0), lambda a, v: a + v)).alias("mk_s"), F.when(enough, (n * (n - 1) * (2 * n + 5) - ties) / 18).alias("mk_var"))


def _tie(c: Column) -> Column:
    return c * (c - 1) * (2 * c + 5)


def _ranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1 within each row; equal values share their mean rank."""
    less = (v[:, None, :] < v[:, :, None]).sum(2)
    same = (v[:, None, :] == v[:, :, None]).sum(2)
    return less + (same + 1) / 2


def adjusted_trends(x: np.ndarray, y: np.ndarray, alpha: float = 0.05) -> dict[str, np.ndarray]:
    """Trends of many series of one length: rows of ``x`` ascend; a test that is not defined is NaN.

    The variance of the Mann-Kendall statistic is adjusted for autocorrelation: rank correlations at all lags of the
    detrended series that lie outside their limit enter a factor.  Residuals are ranked to nine digits of the series' size, so
    that points on the Sen line tie.
    """
    m, n = y.shape
    out = {c: np.full(m, np.nan) for c in ("sen_slope", "sen_intercept", "mk_z", "mk_p", "lag1", "factor", "ols_slope", "ols_r2")}
    if n < 3 or not m:
        return out
    i, j = np.triu_indices(n, 1)
    run, rise = x[:, j] - x[:, i], y[:, j] - y[:, i]
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.nanmedian(np.where(run > 0, rise / run, np.nan), axis=1)
        xc, yc = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
        sxx, sxy, syy = (xc * xc).sum(1), (xc * yc).sum(1), (yc * yc).sum(1)
        out["sen_slope"], out["sen_intercept"] = slope, np.median(y - slope[:, None] * x, axis=1)
        out["ols_slope"], out["ols_r2"] = sxy / sxx, np.where(syy > 0, sxy**2 / (sxx * syy), 0.0)
        s = np.sign(rise).sum(1)
        ties = (y[:, None, :] == y[:, :, None]).sum(2)  # a value's tie size, once for each of its places
        var = (n * (n - 1) * (2 * n + 5) - ((ties - 1) * (2 * ties + 5)).sum(1)) / 18
        size = np.abs(y).max(1, keepdims=True)
        ranks = _ranks(np.round((y - slope[:, None] * x) / np.where(size > 0, size, 1), 9))
        limit, total = normal_quantile(1 - alpha / 2) / math.sqrt(n), np.zeros(m)
        for lag in range(1, n):
            a, b = ranks[:, :-lag], ranks[:, lag:]
            a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
            norm = np.sqrt((a * a).sum(1) * (b * b).sum(1))
            rho = np.where((norm > 0) & (n - lag >= 3), (a * b).sum(1) / norm, 0.0)
            if lag == 1:
                out["lag1"] = rho
            total += np.where(np.abs(rho) > limit, (n - lag) * (n - lag - 1) * (n - lag - 2) * rho, 0.0)
        factor = 1 + 2 / (n * (n - 1) * (n - 2)) * total
        out["factor"] = np.where(factor > 0, factor, 1.0)
        out["mk_z"] = np.where(s == 0, 0.0, (s - np.sign(s)) / np.sqrt(var * out["factor"]))
    out["mk_p"] = normal_sf2(out["mk_z"])
    for c in ("lag1", "factor", "mk_z", "mk_p"):
        out[c] = np.where(var > 0, out[c], np.nan)
    return out


GROUP_SERIES = 4096  # series a group on average


def trends(yearly: DataFrame, values: list[str], pixel: str = "pixel", least: int = 8) -> DataFrame:
    """pixel, variable and the adjusted trend of every series of at least ``least`` years and three different years.

    Pixels are dealt over groups by hash; a group's series of one length are one matrix.
    """
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("y")) for v in values))).alias("v")
    long = yearly.select(pixel, F.col("year").cast("double").alias("x"), each).select(pixel, "x", "v.*").where("y is not null and not isnan(y)")
    series = long.groupBy(pixel, "variable").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("s")).where(F.size("s") >= least)
    series = series.select(pixel, "variable", F.transform("s", lambda p: p["x"]).alias("x"), F.transform("s", lambda p: p["y"]).alias("y"))
    names = [c.split()[0] for c in OUT.split(", ")]
    schema = f"{pixel} {dict(yearly.dtypes)[pixel]}, variable string, {OUT}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, parts = pdf["x"].map(len).to_numpy(np.int64), []
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                for a in range(0, len(own), GROUP_SERIES):
                    at = own[a : a + GROUP_SERIES]
                    x, y = (np.stack(pdf[c].to_numpy()[at]).astype(float) for c in ("x", "y"))
                    few = (np.diff(x, axis=1) > 0).sum(1) < 2
                    got = adjusted_trends(x, y)
                    parts.append(pdf.iloc[at][[pixel, "variable"]].assign(n=n, **{c: np.where(few, np.nan, v) for c, v in got.items()}))
            if parts:
                yield pd.concat(parts)[[pixel, "variable", *names]]

    return series.mapInPandas(run, schema)


def with_fdr(trend_rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Trends with q values by variable (BH and BY) and significance flags."""
    out = fdr(fdr(trend_rows, "mk_p", ["variable"], "bh", "q_bh"), "mk_p", ["variable"], "by", "q_by")
    flag = lambda c: F.coalesce(F.col(c) < alpha, F.lit(False))
    return out.withColumn("sig_raw", flag("mk_p")).withColumn("sig_bh", flag("q_bh")).withColumn("sig_by", flag("q_by"))


def fdr_summary(flagged: DataFrame) -> DataFrame:
    """By variable: tested series and how many trends of either sign pass each rule."""
    up = F.col("sen_slope") > 0
    return flagged.groupBy("variable").agg(F.count("mk_p").alias("n_tested"), *(F.count_if(F.col(f"sig_{k}")).alias(f"n_{k}") for k in ("raw", "bh", "by")), *(F.count_if(F.col(f"sig_{k}") & up).alias(f"n_{k}_up") for k in ("raw", "bh", "by")))


def spatial_stats(panel: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Mean and deviation by place."""
    return panel.groupBy(*keys).agg(*(a for v in values for a in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd"))))


def profile(panel: DataFrame, values: list[str], axis: Column, name: str) -> DataFrame:
    """Means by a rounded coordinate."""
    return panel.groupBy(axis.alias(name)).agg(*(F.avg(v).alias(f"{v}_mean") for v in values), F.count("*").alias("n"))
