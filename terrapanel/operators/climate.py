"""Effect modification by the temperature anomaly, from pixel-month components.

theta = month intercept + gamma * anomaly.  Normal equations and cluster scores are sums by (block, year), so only blocks
x years short rows come to the driver for the small solve.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import t_quantile, t_sf2
from .bootstrap import multiplier_year
from .features import anomaly
from .quantiles import quantiles

MONTHS = (4, 5, 6, 7, 8, 9)


def supported(comp: DataFrame, value: str = "t2m", pixel: str = "pixel", months: tuple[int, ...] = MONTHS, least_years: int = 10) -> DataFrame:
    """Component rows of the active months with their anomaly, where the pixel-month's mean rests on enough years."""
    rows = comp.where(F.col("month").isin(*months) & F.col(value).isNotNull())
    return anomaly(rows, value, [pixel, "month"], least_years).where(F.col(f"{value}_anomaly").isNotNull() & (F.col("den") > 0))


def climatology_support(comp: DataFrame, value: str = "t2m", pixel: str = "pixel", least_years: int = 10) -> DataFrame:
    """month, pixels, pixels with a usable mean and the mean number of years."""
    per = comp.where(F.col(value).isNotNull()).groupBy(pixel, "month").agg(F.count("*").alias("years"))
    return per.groupBy("month").agg(F.count("*").alias("n_pixels"), F.count_if(F.col("years") >= least_years).alias("n_supported"), F.avg("years").alias("mean_years"))


def gram(rows: DataFrame, keys: list[str], value: str = "t2m") -> DataFrame:
    """keys, month and the sums den, den*a, den*a*a, num, num*a (a: anomaly): all that the normal equations need."""
    a = F.col(f"{value}_anomaly")
    return rows.groupBy(*keys, "month").agg(F.sum("den").alias("s"), F.sum(F.col("den") * a).alias("sa"), F.sum(F.col("den") * a * a).alias("saa"), F.sum("num").alias("u"), F.sum(F.col("num") * a).alias("ua"))


def weighted_moments(rows: DataFrame, value: str = "t2m") -> DataFrame:
    """Information-weighted mean and population deviation of the anomaly, and its plain ones."""
    a, w = F.col(f"{value}_anomaly"), F.col("den")
    m = rows.agg(F.sum(w).alias("w"), F.sum(w * a).alias("wa"), F.sum(w * a * a).alias("waa"), F.avg(a).alias("mean"), F.stddev_samp(a).alias("sd"), F.count("*").alias("n"))
    mean = F.col("wa") / F.col("w")
    return m.select("n", "mean", "sd", mean.alias("weighted_mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("waa") / F.col("w") - mean * mean)).alias("weighted_sd"))


class Fit(NamedTuple):
    """Month intercepts and the slope (last), their covariances by kind of clusters, degrees of freedom, and the kind that is used."""

    months: list[int]
    beta: np.ndarray
    cov: dict[str, np.ndarray]
    df: dict[str, int]
    chosen: str
    year_scores: np.ndarray
    inverse: np.ndarray


def fitted(rows: DataFrame, value: str = "t2m", block: str = "block", months: tuple[int, ...] = MONTHS) -> Fit:
    g = gram(rows, [block, "year"], value).toPandas()
    present = [m for m in months if (g["month"] == m).any()]
    p, at = len(present) + 1, {m: i for i, m in enumerate(present)}
    i = g["month"].map(at).to_numpy()
    h, rhs = np.zeros((p, p)), np.zeros(p)
    np.add.at(h, (i, i), g["s"])
    np.add.at(h, (i, p - 1), g["sa"])
    h[p - 1, : p - 1], h[p - 1, p - 1] = h[: p - 1, p - 1], g["saa"].sum()
    np.add.at(rhs, i, g["u"])
    rhs[p - 1] = g["ua"].sum()
    inv = np.linalg.pinv(h)
    beta = inv @ rhs
    score = np.zeros((len(g), p))
    score[np.arange(len(g)), i] = g["u"] - g["s"] * beta[i] - g["sa"] * beta[p - 1]
    score[:, p - 1] = g["ua"] - g["sa"] * beta[i] - g["saa"] * beta[p - 1]
    sums = lambda keys: pd.DataFrame(score).groupby([g[k] for k in keys]).sum().to_numpy()
    by = {k: sums(c) for k, c in (("block", [block]), ("year", ["year"]), ("both", [block, "year"]))}
    meat = {k: s.T @ s * (len(s) / max(1, len(s) - 1)) for k, s in by.items()}
    cov = {"two_way": inv @ (meat["block"] + meat["year"] - meat["both"]) @ inv, "year": inv @ meat["year"] @ inv, "block": inv @ meat["block"] @ inv}
    valid = (np.diag(cov["two_way"]) > 0).all()
    df = {"two_way": max(1, min(len(by["block"]), len(by["year"])) - 1), "year": max(1, len(by["year"]) - 1), "block": max(1, len(by["block"]) - 1)}
    return Fit(present, beta, cov, df, "two_way" if valid else "year", by["year"], inv)


def modifier(rows: DataFrame, value: str = "t2m", block: str = "block", months: tuple[int, ...] = MONTHS, reps: int = 4999, seed: int = 42) -> pd.DataFrame:
    """A row a parameter: estimate per 10, errors by two-way, year and block clusters, and the multiplier p of gamma."""
    present, beta, cov, df, chosen, scores, inv = fitted(rows, value, block, months)
    p, (p_flip, low, high) = len(beta), multiplier_year(scores, inv, float(beta[-1]), reps, seed)
    out = []
    for j, name in enumerate([*(f"month_{m:02d}" for m in present), f"{value}_anomaly"]):
        row = {"parameter": name, "estimate": beta[j] * 10, "covariance": chosen}
        for k in ("two_way", "year", "block"):
            row[f"se_{k}"] = float(np.sqrt(cov[k][j, j]) * 10) if cov[k][j, j] > 0 else np.nan
        se = row[f"se_{chosen}"]
        crit = float(t_quantile(0.975, np.array([df[chosen]]))[0])
        row |= {"t_df": df[chosen], "ci_low": row["estimate"] - crit * se, "ci_high": row["estimate"] + crit * se, "p_t": float(t_sf2(np.array([row["estimate"] / se]), np.array([df[chosen]]))[0])}
        row |= {"p_multiplier": p_flip, "multiplier_low": low * 10, "multiplier_high": high * 10} if j == p - 1 else {"p_multiplier": np.nan, "multiplier_low": np.nan, "multiplier_high": np.nan}
        out.append(row)
    return pd.DataFrame(out)


def response_curves(rows: DataFrame, fit: Fit, value: str = "t2m", points: int = 121, span: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """curve (``mean`` of the months, or a month), point, anomaly, effect per 10 and its t interval, between two quantiles of the anomaly."""
    low, high = quantiles(rows, [], f"{value}_anomaly", {"low": span[0], "high": span[1]}).select("low", "high").first()
    k, crit = len(fit.months), float(t_quantile(0.975, np.array([fit.df[fit.chosen]]))[0])
    weights = {"mean": np.full(k, 1.0 / k)} | {f"{m:02d}": np.eye(k)[i] for i, m in enumerate(fit.months)}
    out = []
    for name, w in weights.items():
        for i, a in enumerate(np.linspace(low, high, points)):
            c = np.append(w, a)
            effect, se = float(c @ fit.beta) * 10, float(np.sqrt(max(0.0, c @ fit.cov[fit.chosen] @ c))) * 10
            out.append((name, i, float(a), effect, effect - crit * se, effect + crit * se))
    return rows.sparkSession.createDataFrame(out, "curve string, point int, anomaly double, effect double, ci_low double, ci_high double")


def direction(parameters: pd.DataFrame, fit: Fit, alpha: float = 0.05) -> str:
    """negative or positive where the intervals of the slope by both kinds of clusters lie on one side and the multiplier test agrees; else unclear."""
    row, gamma = parameters.iloc[-1], float(fit.beta[-1])
    reach = max(float(t_quantile(1 - alpha / 2, np.array([fit.df[k]]))[0]) * float(np.sqrt(max(0.0, fit.cov[k][-1, -1]))) for k in (fit.chosen, "year"))
    if row["p_multiplier"] >= alpha or abs(gamma) <= reach:
        return "unclear"
    return "negative" if gamma < 0 else "positive"


def decision(parameters: pd.DataFrame, fit: Fit) -> dict[str, object]:
    """The record of the modifier's reading: its direction, estimate, interval, and the p values of the three tests behind it."""
    row = parameters.iloc[-1]
    year_se = math.sqrt(max(0.0, float(fit.cov["year"][-1, -1]))) * 10
    by_year = float(t_sf2(np.array([row["estimate"] / year_se]), np.array([fit.df["year"]]))[0]) if year_se > 0 else math.nan
    return {
        "direction": direction(parameters, fit), "parameter": row["parameter"], "estimate": float(row["estimate"]), "ci_low": float(row["ci_low"]), "ci_high": float(row["ci_high"]), "covariance": fit.chosen,
        "p_t": float(row["p_t"]), "p_year": by_year, "p_multiplier": float(row["p_multiplier"]), "note": "modification of an adjusted association by the state of the climate; other windows or variables are not searched after it",
    }
