"""Wild cluster resampling on score cells.

Resampling needs a stratum's scores by cluster only (products of months summed over blocks, or years), never its rows.  Strata are resampled
in parallel by grouped maps; a group holds months x months or years rows, whatever the number of blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import merged

#: The six-point weights.
WEBB = np.array([-np.sqrt(1.5), -1.0, -np.sqrt(0.5), np.sqrt(0.5), 1.0, np.sqrt(1.5)])
REPS, SEED = 9999, 20260921
TIE = 1e-9  # statistics that differ by less are equal


def draws(seed: int, key: tuple, reps: range, clusters: list) -> np.ndarray:
    """Six-point weights, a row a repetition and a column a cluster: by an MD5 of seed, stratum, repetition and cluster."""
    head = ":".join(map(str, (seed, *key)))
    return WEBB[np.array([[int(hashlib.md5(f"{head}:{r}:{c}".encode()).hexdigest()[:7], 16) % 6 for c in clusters] for r in reps], int).reshape(len(reps), len(clusters))]


def _factor(g: int) -> float:
    return g / (g - 1) if g > 1 else 1.0


def month_products(cells: DataFrame, strata: list[str], block: str, month: str) -> DataFrame:
    """strata, theta, total, g1 and, by pairs m <= n of months, sums over blocks of the products of scores and denominators.

    ``ss``, ``sd``, ``ds``, ``dd`` (score or denominator of m, then of n); of a month with itself also ``s``, ``d``, and over its occupied
    cells ``own`` (squared scores) and ``cells`` (their number).  Months x months rows a stratum, however many blocks there are.
    """
    blocks = cells.groupBy(*strata, block).agg(F.collect_list(F.struct(F.col(month).alias("m"), "num", "den")).alias("_c"), F.sum("num").alias("_num"), F.sum("den").alias("_den"))
    whole = blocks.groupBy(*strata).agg((F.sum("_num") / F.sum("_den")).alias("theta"), F.sum("_den").alias("total"), F.count("*").alias("g1"))
    each = blocks.select(*strata, "_c").join(whole, strata)
    pairs = each.select(*strata, "theta", "total", "g1", "_c", F.explode("_c").alias("_a")).withColumn("_b", F.explode("_c")).where("_a.m <= _b.m")
    score = lambda c: F.col(f"{c}.num") - F.col("theta") * F.col(f"{c}.den")
    pairs = pairs.select(*strata, "theta", "total", "g1", F.col("_a.m").alias("m"), F.col("_b.m").alias("n"), score("_a").alias("_s"), score("_b").alias("_t"), F.col("_a.den").alias("_d"), F.col("_b.den").alias("_e"))
    s, t, d, e = map(F.col, ("_s", "_t", "_d", "_e"))
    sums = {"ss": s * t, "sd": s * e, "ds": d * t, "dd": d * e, "s": s, "d": d, "own": F.when(d > 0, s * s).otherwise(0.0)}
    return pairs.groupBy(*strata, "theta", "total", "g1", "m", "n").agg(*(F.sum(v).alias(k) for k, v in sums.items()), F.count_if(d > 0).alias("cells"))


def _studentised(pdf: pd.DataFrame, months: np.ndarray, weights: np.ndarray, observed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Estimate shift and two-way standard error for each row of month weights, from a stratum's ``month_products``.

    A repetition's cells are score x weight - shift x denominator (``observed``: without shift), so their sums of squares by block are
    quadratic forms in the weights.
    """
    total, g1 = float(pdf["total"].iloc[0]), int(pdf["g1"].iloc[0])
    i, j = np.searchsorted(months, pdf["m"]), np.searchsorted(months, pdf["n"])
    gram, cross, dens = (np.zeros((len(months), len(months))) for _ in range(3))
    gram[i, j] = gram[j, i] = pdf["ss"]
    cross[i, j], cross[j, i] = pdf["sd"], pdf["ds"]
    dens[i, j] = dens[j, i] = pdf["dd"]
    one = pdf[pdf["m"] == pdf["n"]].sort_values("m")
    s, d, own = (one[c].to_numpy(float) for c in ("s", "d", "own"))
    shift = np.zeros(len(weights)) if observed else weights @ s / total
    m1 = ((weights @ gram) * weights).sum(1) - 2 * shift * (weights @ cross.sum(1)) + shift**2 * dens.sum()
    m2 = ((weights * s - shift[:, None] * d) ** 2).sum(1)
    m12 = weights**2 @ own - 2 * shift * (weights @ np.diag(cross)) + shift**2 * np.trace(dens)
    m1, m2, m12 = np.maximum(0.0, m1) * _factor(g1), m2 * _factor(len(months)), m12 * _factor(int(one["cells"].sum()))
    v = m1 + m2 - m12
    return shift, np.sqrt(np.where(v > 0, v, np.maximum(m1, m2))) / total


def wild_month(comp: DataFrame, strata: list[str], block: str = "block", month: str = "month", reps: int = REPS, seed: int = SEED, batch: int = 128) -> DataFrame:
    """Bootstrap-t over month clusters with two-way studentisation: strata, theta, se, critical, p, g1, g2."""
    sums = month_products(merged(comp, [*strata, block, month]), strata, block, month)
    kinds = dict(sums.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mu = np.unique(pdf["m"])
        theta, se = float(pdf["theta"].iloc[0]), _studentised(pdf, mu, np.ones((1, len(mu))), observed=True)[1][0]
        drawn = []
        for at in range(0, reps, batch):
            shift, error = _studentised(pdf, mu, draws(seed, key, range(at, min(reps, at + batch)), mu.tolist()))
            drawn.append(np.abs(shift / error))
        t = np.concatenate(drawn)
        return pd.DataFrame([(*key, theta, se, float(np.quantile(t, 0.95)), float((1 + (t >= abs(theta / se) * (1 - TIE)).sum()) / (reps + 1)), int(pdf["g1"].iloc[0]), len(mu))], columns=[*strata, "theta", "se", "critical", "p_wild", "g1", "g2"])

    return sums.groupBy(*strata).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in strata), "theta double, se double, critical double, p_wild double, g1 long, g2 long"]))


def wild_year(comp: DataFrame, strata: list[str] | None = None, year: str = "year", reps: int = REPS, seed: int = SEED, batch: int = 2000) -> DataFrame:
    """Year clusters: p of no effect from raw yearly sums, basic interval from centred ones."""
    keys = strata or ["_all"]
    cells = merged(comp if strata else comp.withColumn("_all", F.lit(0)), [*keys, year])
    kinds = dict(cells.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(year)
        num, den = pdf["num"].to_numpy(float), pdf["den"].to_numpy(float)
        g, theta = len(num), num.sum() / den.sum()
        u, factor = num - theta * den, _factor(len(num))
        seen = num.sum() / np.sqrt(factor * (num @ num))
        beyond, delta = 0, []
        for at in range(0, reps, batch):
            w = draws(seed, key, range(at, min(reps, at + batch)), pdf[year].tolist())
            t = (w * num).sum(1) / np.sqrt(factor * ((w * num) ** 2).sum(1))
            beyond += int((np.abs(t) >= abs(seen) * (1 - TIE)).sum())
            delta.append((w * u).sum(1) / den.sum())
        q = np.quantile(np.concatenate(delta), [0.025, 0.975])
        return pd.DataFrame([(*key, theta, (1 + beyond) / (reps + 1), theta - q[1], theta - q[0], g)], columns=[*keys, "theta", "p_wild", "ci_low", "ci_high", "g"])

    out = cells.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "theta double, p_wild double, ci_low double, ci_high double, g long"]))
    return out if strata else out.drop("_all")


def multiplier_year(scores: np.ndarray, inverse: np.ndarray, estimate: float, reps: int = 4999, seed: int = 42) -> tuple[float, float, float]:
    """p value and percentile interval of the last coefficient from sign flips of year scores."""
    w = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (reps, len(scores)))
    delta = ((w @ scores) @ inverse.T)[:, -1]
    low, high = np.quantile(estimate + delta, [0.025, 0.975])
    return float((1 + (np.abs(delta) >= abs(estimate)).sum()) / (reps + 1)), float(low), float(high)
