"""Effects and clustered uncertainty from components.

An effect is sum(num) / sum(den).  Its variance is m1 + m2 - m12 over den squared, where m is the sum of squared
cluster scores for the first, the second and the crossed clusters; grouping sets give all three in one pass.  Where
that is not positive the larger one-way variance stands in (``fallback``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import f_sf, normal_p_value, sign_p_value, t_critical, t_p_value, t_quantile, t_sf2
from .components import merged


def effects(comp: DataFrame, strata: list[str], total: bool = False) -> DataFrame:
    """strata, theta, num, den, n."""
    out = comp.groupBy(*strata) if strata else comp.groupBy()
    out = out.agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("n").alias("n"))
    return out.withColumn("theta", F.try_divide("num", "den"))


def small_sample(g: Column, on: bool) -> Column:
    return F.when((g > 1), g / (g - 1)).otherwise(F.lit(1.0)) if on else F.lit(1.0)


def _key(strata: list[str]) -> list[str]:
    return strata or ["_all"]


def two_way(comp: DataFrame, strata: list[str], c1: str, c2: str, small: bool = True) -> DataFrame:
    """strata, theta, se, var, fallback, g1, g2, g12, num, den, n from components by stratum and both clusters."""
    keys = _key(strata)
    cells = merged(comp if strata else comp.withColumn("_all", F.lit(1)), [*keys, c1, c2])
    total = effects(cells, keys)
    scored = cells.join(total.select(*keys, "theta"), keys).withColumn("score", F.col("num") - F.col("theta") * F.col("den"))
    sets = [[*map(F.col, keys), F.col(c1)], [*map(F.col, keys), F.col(c2)], [*map(F.col, keys), F.col(c1), F.col(c2)]]
    sums = scored.groupingSets(sets, *map(F.col, keys), F.col(c1), F.col(c2)).agg(F.sum("score").alias("s"), F.grouping(c1).alias("no1"), F.grouping(c2).alias("no2"))
    one, two, both = F.col("no2") == 1, F.col("no1") == 1, (F.col("no1") == 0) & (F.col("no2") == 0)
    meat = sums.groupBy(*keys).agg(*(F.sum(F.when(c, F.col("s") * F.col("s"))).alias(f"m{n}") for n, c in (("1", one), ("2", two), ("12", both))), *(F.count_if(c).alias(f"g{n}") for n, c in (("1", one), ("2", two), ("12", both))))
    m1, m2, m12 = (F.col(f"m{n}") * small_sample(F.col(f"g{n}"), small) for n in ("1", "2", "12"))
    out = total.join(meat, keys).withColumn("_v", (m1 + m2 - m12) / (F.col("den") * F.col("den"))).withColumn("_w", F.greatest(m1, m2) / (F.col("den") * F.col("den")))
    out = out.withColumn("fallback", ~(F.col("_v") > 0)).withColumn("var", F.when(F.col("_v") > 0, F.col("_v")).otherwise(F.col("_w")))
    return out.withColumn("se", F.sqrt("var")).select(*strata, "theta", "se", "var", "fallback", "g1", "g2", "g12", "num", "den", "n")


def one_way(comp: DataFrame, strata: list[str], c1: str, small: bool = True) -> DataFrame:
    """strata, theta, se, g1, num, den, n with one cluster."""
    keys = _key(strata)
    cells = merged(comp if strata else comp.withColumn("_all", F.lit(1)), [*keys, c1])
    total = effects(cells, keys)
    scored = cells.join(total.select(*keys, "theta"), keys).withColumn("score", F.col("num") - F.col("theta") * F.col("den"))
    meat = scored.groupBy(*keys).agg(F.sum(F.col("score") * F.col("score")).alias("m1"), F.count("*").alias("g1"))
    out = total.join(meat, keys).withColumn("se", F.sqrt(F.col("m1") * small_sample(F.col("g1"), small)) / F.col("den"))
    return out.select(*strata, "theta", "se", "g1", "num", "den", "n")


def with_t(df: DataFrame, scale: float = 10.0, second: str | None = "g2") -> DataFrame:
    """Effect per ``scale``, its error, normal and t intervals and p values of rows with theta, se and cluster counts."""
    g = F.least("g1", second) if second else F.col("g1")
    out = df.withColumn("t_df", F.greatest(g - 1, F.lit(1)).cast("int")).withColumn("_c", t_critical(F.col("t_df").cast("double")))
    z = F.try_divide("theta", "se")
    named = {
        "effect": F.col("theta") * scale, "effect_se": F.col("se") * scale,
        "ci_normal_low": (F.col("theta") - 1.96 * F.col("se")) * scale, "ci_normal_high": (F.col("theta") + 1.96 * F.col("se")) * scale,
        "ci_t_low": (F.col("theta") - F.col("_c") * F.col("se")) * scale, "ci_t_high": (F.col("theta") + F.col("_c") * F.col("se")) * scale,
        "p_normal": normal_p_value(z), "p_t": t_p_value(z, F.col("t_df").cast("double")),
    }
    return out.withColumns(named).drop("_c")


def annual_signs(comp: DataFrame, strata: list[str]) -> DataFrame:
    """strata, n_years, n_negative, median_effect of yearly effects, and the exact sign test's p value."""
    yearly = effects(comp, [*strata, "year"])
    out = yearly.groupBy(*strata).agg(F.count("*").alias("n_years"), F.count_if(F.col("theta") < 0).alias("n_negative"), F.percentile("theta", F.lit(0.5)).alias("median_effect"))
    return out.withColumn("sign_p", sign_p_value("n_negative", "n_years"))


def contrast(rows: DataFrame, value: str, c1: str, c2: str) -> DataFrame:
    """Variance of a sum of influence values with two-way clusters: se, g1, g2, g12, fallback (one row)."""
    cells = rows.groupBy(c1, c2).agg(F.sum(value).alias("s"))
    sums = cells.groupingSets([[F.col(c1)], [F.col(c2)], [F.col(c1), F.col(c2)]], F.col(c1), F.col(c2)).agg(F.sum("s").alias("s"), F.grouping(c1).alias("no1"), F.grouping(c2).alias("no2"))
    one, two, both = F.col("no2") == 1, F.col("no1") == 1, (F.col("no1") == 0) & (F.col("no2") == 0)
    meat = sums.groupBy().agg(*(F.sum(F.when(c, F.col("s") * F.col("s"))).alias(f"m{n}") for n, c in (("1", one), ("2", two), ("12", both))), *(F.count_if(c).alias(f"g{n}") for n, c in (("1", one), ("2", two), ("12", both))))
    m1, m2, m12 = (F.col(f"m{n}") * small_sample(F.col(f"g{n}"), True) for n in ("1", "2", "12"))
    v = m1 + m2 - m12
    return meat.withColumn("fallback", ~(v > 0)).withColumn("se", F.sqrt(F.when(v > 0, v).otherwise(F.greatest(m1, m2)))).select("se", "fallback", "g1", "g2", "g12")


def paired_contrast(rows: DataFrame, pair: tuple[str, str], other: tuple[str, str], c1: str, c2: str) -> DataFrame:
    """Difference of two effects over the same rows (residual columns d and r of each), its error and clusters."""
    (d1, r1), (d2, r2) = pair, other
    t = rows.agg(*(F.sum(F.col(a) * F.col(b)).alias(n) for a, b, n in ((d1, r1, "n1"), (d1, d1, "v1"), (d2, r2, "n2"), (d2, d2, "v2")))).first()
    if not t["v1"] or not t["v2"]:
        raise ValueError("a contrast needs rows with variation of both exposures")
    theta1, theta2 = t["n1"] / t["v1"], t["n2"] / t["v2"]
    infl = lambda d, r, th, v: F.col(d) * (F.col(r) - th * F.col(d)) / v
    out = contrast(rows.withColumn("_i", infl(d1, r1, theta1, t["v1"]) - infl(d2, r2, theta2, t["v2"])), "_i", c1, c2)
    return out.select(F.lit(theta1).alias("theta_first"), F.lit(theta2).alias("theta_second"), F.lit(theta1 - theta2).alias("difference"), "*")


# ---------------------------------------------------------------- several parameters


def joint_sums(rows: DataFrame, ds: list[str], r: str, keys: list[str]) -> DataFrame:
    """keys, h (products of the d columns, upper triangle) and u (products with r) as columns h_i_j and u_i."""
    k = len(ds)
    return rows.groupBy(*keys).agg(*(F.sum(F.col(ds[i]) * F.col(ds[j])).alias(f"h_{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(F.col(ds[i]) * F.col(r)).alias(f"u_{i}") for i in range(k)))


def _symmetric(values: pd.DataFrame, k: int) -> np.ndarray:
    out = np.zeros((len(values), k, k))
    for i in range(k):
        for j in range(i, k):
            out[:, i, j] = out[:, j, i] = values[f"h_{i}_{j}"]
    return out


def _non_negative(cov: np.ndarray) -> np.ndarray:
    vals, vec = np.linalg.eigh((cov + cov.T) / 2)
    return (vec * np.clip(vals, 0, None)) @ vec.T


def _sandwich(cells: pd.DataFrame, beta: np.ndarray, h: np.ndarray, c1: str, c2: str, small: bool) -> tuple[np.ndarray, int, int, int]:
    k = len(beta)
    score = cells[[f"u_{i}" for i in range(k)]].to_numpy() - np.einsum("nij,j->ni", _symmetric(cells, k), beta)
    meat, counts = np.zeros((k, k)), []
    for keys, sign in (([c1], 1), ([c2], 1), ([c1, c2], -1)):
        s = pd.DataFrame(score).groupby([cells[c] for c in keys]).sum().to_numpy()
        g = len(s)
        counts.append(g)
        meat += sign * (s.T @ s) * (g / (g - 1) if small and g > 1 else 1.0)
    inv = np.linalg.inv(h)
    return _non_negative(inv @ meat @ inv), *counts


def joint_effects(rows: DataFrame, ds: list[str], r: str, c1: str, c2: str, strata: list[str] | None = None, small: bool = True) -> DataFrame:
    """Effects of several exposures at once with a two-way sandwich; sums by cluster cell are solved a stratum at a time."""
    keys = _key(strata or [])
    base = rows if strata else rows.withColumn("_all", F.lit(1))
    cells = joint_sums(base, ds, r, [*keys, c1, c2])
    kinds = dict(cells.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k = len(ds)
        h = _symmetric(pdf, k).sum(0)
        if np.linalg.matrix_rank(h) < k:  # not identified
            return pd.DataFrame([(*key, d, np.nan, np.nan, 0, 0, 0) for d in ds], columns=[*keys, "exposure", "theta", "se", "g1", "g2", "g12"])
        beta = np.linalg.solve(h, pdf[[f"u_{i}" for i in range(k)]].to_numpy().sum(0))
        cov, g1, g2, g12 = _sandwich(pdf, beta, h, c1, c2, small)
        return pd.DataFrame([(*key, ds[i], beta[i], float(np.sqrt(max(0.0, cov[i, i]))), g1, g2, g12) for i in range(k)], columns=[*keys, "exposure", "theta", "se", "g1", "g2", "g12"])

    out = cells.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "exposure string, theta double, se double, g1 long, g2 long, g12 long"]))
    return out if strata else out.drop("_all")


def score_regression(comp: DataFrame, design: list[str], c1: str = "block", c2: str = "year") -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients of the effect on design columns of the components, their covariance and t degrees of freedom.

    Sums by (c1, c2) cell come to the driver: blocks x years rows.
    """
    k = len(design)
    z = [F.col(c) for c in design]
    cells = comp.groupBy(c1, c2).agg(*(F.sum(z[i] * z[j] * F.col("den")).alias(f"h_{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(z[i] * F.col("num")).alias(f"u_{i}") for i in range(k))).toPandas()
    h = _symmetric(cells, k).sum(0)
    beta = np.linalg.solve(h, cells[[f"u_{i}" for i in range(k)]].to_numpy().sum(0))
    cov, g1, g2, _ = _sandwich(cells, beta, h, c1, c2, True)
    return beta, cov, max(1, min(g1, g2) - 1)


def linear_contrast(beta: np.ndarray, cov: np.ndarray, df: int, weights: list[float], name: str, scale: float = 10.0) -> dict:
    w = np.asarray(weights, float)
    est, se = float(w @ beta), float(np.sqrt(max(0.0, w @ cov @ w)))
    crit = float(t_quantile(0.975, np.array([df]))[0])
    p = float(t_sf2(np.array([est / se]), np.array([df]))[0]) if se > 0 else None
    return {"test": name, "estimate": est * scale, "se": se * scale, "p_t": p, "ci_low": (est - crit * se) * scale, "ci_high": (est + crit * se) * scale, "t_df": df}


def linear_trend(comp: DataFrame, least_years: int = 3) -> DataFrame:
    """Slope of the effect on the centred year (one row)."""
    years = sorted(r[0] for r in comp.select("year").distinct().collect())
    if len(years) < least_years:
        raise ValueError(f"at least {least_years} years are needed")
    centre = float(np.mean(years))
    beta, cov, df = score_regression(comp.withColumn("_1", F.lit(1.0)).withColumn("_t", F.col("year") - centre), ["_1", "_t"])
    row = linear_contrast(beta, cov, df, [0, 1], "linear_trend_per_year")
    return comp.sparkSession.createDataFrame([tuple(row.values())], "test string, estimate double, se double, p_t double, ci_low double, ci_high double, t_df int")


def pair_covariances(comp: DataFrame, strata: str, c1: str = "block", c2: str = "year") -> DataFrame:
    """s, t, theta_s, theta_t, cov: two-way covariances of the effects of every two strata (and of each with itself).

    Scores of one cluster meet on the cluster's key: the join has at most strata x strata rows a cluster.
    """
    cells = merged(comp, [strata, c1, c2]).persist()  # strata x clusters short rows, read by each of the joins
    total = effects(cells, [strata])
    scored = cells.join(total.select(strata, "theta", F.col("den").alias("total")), strata).withColumn("v", (F.col("num") - F.col("theta") * F.col("den")) / F.col("total"))
    counts = cells.agg(F.count_distinct(c1).alias("g1"), F.count_distinct(c2).alias("g2"), F.count_distinct(c1, c2).alias("g12")).first()
    parts = None
    for keys, g, sign in (([c1], counts["g1"], 1.0), ([c2], counts["g2"], 1.0), ([c1, c2], counts["g12"], -1.0)):
        one = scored.groupBy(strata, *keys).agg(F.sum("v").alias("v"))
        a = one.select(*keys, F.col(strata).alias("s"), F.col("v").alias("a"))
        b = one.select(*keys, F.col(strata).alias("t"), F.col("v").alias("b"))
        part = a.join(b, keys).where("s <= t").groupBy("s", "t").agg((F.sum(F.col("a") * F.col("b")) * (sign * (g / (g - 1) if g > 1 else 1.0))).alias("m"))
        parts = part if parts is None else parts.unionByName(part)
    cov = parts.groupBy("s", "t").agg(F.sum("m").alias("cov"))
    th = total.select(strata, "theta")
    return cov.join(th.select(F.col(strata).alias("s"), F.col("theta").alias("theta_s")), "s").join(th.select(F.col(strata).alias("t"), F.col("theta").alias("theta_t")), "t").select("s", "t", "theta_s", "theta_t", "cov")


def heterogeneity(comp: DataFrame, strata: str, c1: str = "block", c2: str = "year") -> tuple[dict, pd.DataFrame]:
    """Wald F test that all strata share one effect, and all pairwise t tests with Holm p values (k x k on the driver)."""
    from .multiplicity import holm_values

    pairs = pair_covariances(comp, strata, c1, c2).toPandas()
    names = sorted(set(pairs["s"]))
    k, at = len(names), {n: i for i, n in enumerate(sorted(set(pairs["s"])))}
    theta, cov = np.zeros(k), np.zeros((k, k))
    for r in pairs.itertuples(index=False):
        cov[at[r.s], at[r.t]] = cov[at[r.t], at[r.s]] = r.cov
        theta[at[r.s]], theta[at[r.t]] = r.theta_s, r.theta_t
    cov = _non_negative(cov)
    g = comp.agg(F.count_distinct(c1), F.count_distinct(c2)).first()
    d2 = max(1, min(g[0], g[1]) - 1)
    c = np.hstack([-np.ones((k - 1, 1)), np.eye(k - 1)])
    diff = c @ theta
    wald = float(diff @ np.linalg.pinv(c @ cov @ c.T) @ diff) / (k - 1) if k > 1 else 0.0
    test = {"f": wald, "df1": k - 1, "df2": d2, "p": float(f_sf(np.array([wald]), np.array([k - 1]), np.array([d2]))[0]) if k > 1 else 1.0}
    rows = []
    for i in range(k):
        for j in range(i + 1, k):
            se = float(np.sqrt(max(0.0, cov[i, i] + cov[j, j] - 2 * cov[i, j])))
            t = (theta[j] - theta[i]) / se if se > 0 else np.nan
            rows.append((names[i], names[j], theta[j] - theta[i], se, float(t_sf2(np.array([t]), np.array([d2]))[0])))
    out = pd.DataFrame(rows, columns=["first", "second", "difference", "se", "p_t"])
    out["p_holm"] = holm_values(out["p_t"].to_numpy())
    return test, out


def repooled(comp: DataFrame, strata: str, thresholds: list[int], cell: list[str], c1: str = "block", c2: str = "year") -> DataFrame:
    """Two-way effects by stratum from the cells with at least each threshold of rows; nothing is fitted anew."""
    size = comp.groupBy(*cell).agg(F.sum("n").alias("cell_n"))
    each = size.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where("cell_n >= threshold")
    return two_way(comp.join(each.drop("cell_n"), cell), [strata, "threshold"], c1, c2)
