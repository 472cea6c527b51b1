"""Gaussian kernel effect maps on a sparse grid.

Smoothing is separable and goes by tiles of the grid: a cell is sent to the tiles whose edges lie within its reach (about two
and a half on average, whatever the bandwidth), and a tile with its halo is a dense matrix that two banded matrices smooth along both axes.  The
shuffle thus holds cells, not cells times offsets.  Cells outside the grid do not exist, which is zero padding.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distributions import t_critical
from ..functions.grid import Grid
from .quantiles import quantile

TILE = 128
#: Fixed values of the support mask.
SUPPORT = {"years": 10, "mean_years": 10.0, "pixels": 50.0, "den_q": 0.05, "se_q": 0.95, "least_weight": 1e-10}


def weights(bandwidth_km: float, spacing: float, truncate: float = 2.0) -> list[tuple[int, float]]:
    """(offset, weight) of a normalised Gaussian; the radius is half-up rounded and at least 1."""
    sigma = max(bandwidth_km * 1000.0 / spacing, 1e-6)
    radius = max(1, int(truncate * sigma + 0.5))
    raw = {u: math.exp(-0.5 * (u / sigma) ** 2) for u in range(-radius, radius + 1)}
    total = sum(raw.values())
    return [(u, v / total) for u, v in raw.items()]


def band(table: list[tuple[int, float]], size: int, power: int = 1) -> np.ndarray:
    """The matrix (size x size + 2 radius) that smooths a line with its halo."""
    radius = table[-1][0]
    out = np.zeros((size, size + 2 * radius))
    for u, w in table:
        out[np.arange(size), np.arange(size) + radius + u] = w**power
    return out


def smooth(df: DataFrame, values: list[str], keys: list[str], grid: Grid, bandwidth_km: float, truncate: float = 2.0, power: int = 1, squared: list[str] | None = None) -> DataFrame:
    """keys, ix, iy and the smoothed values (``power`` 2: with squared weights) of every cell within reach.

    The values named in ``squared`` are smoothed with squared weights as well, as <name>2.  NULL and NaN count as 0.  A task holds one tile at
    a time: about (TILE + 2 radius) squared numbers a value.
    """
    x, y = weights(bandwidth_km, grid.dx, truncate), weights(bandwidth_km, grid.dy, truncate)
    rx, ry, squared = x[-1][0], y[-1][0], squared or []
    tx, ty = max(TILE, 4 * rx), max(TILE, 4 * ry)
    reach = lambda c, r, t, n: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - r) / t)), F.least(F.lit((n - 1) // t), F.floor((F.col(c) + r) / t)))
    inside = df.where(F.col("ix").between(0, grid.nx - 1) & F.col("iy").between(0, grid.ny - 1))
    cells = inside.select(*keys, "ix", "iy", *(F.col(v).cast("double").alias(v) for v in values), F.explode(reach("ix", rx, tx, grid.nx)).alias("_tx")).withColumn("_ty", F.explode(reach("iy", ry, ty, grid.ny)))
    kinds, own = dict(cells.dtypes), [*keys, "_tx", "_ty"]
    out_schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"ix {kinds['ix']}", f"iy {kinds['iy']}", *(f"{v} double" for v in values), *(f"{v}2 double" for v in squared)])

    def tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = int(key[-2]) * tx, int(key[-1]) * ty
        wide, high = min(tx, grid.nx - a), min(ty, grid.ny - b)
        along, across = band(x, wide, power), band(y, high, power)
        i, j = rows["ix"].to_numpy() - a + rx, rows["iy"].to_numpy() - b + ry
        here = (i >= 0) & (i < wide + 2 * rx) & (j >= 0) & (j < high + 2 * ry)  # a last tile is narrower

        def dense(column: np.ndarray) -> np.ndarray:
            m = np.zeros((wide + 2 * rx, high + 2 * ry))
            np.add.at(m, (i[here], j[here]), np.nan_to_num(column[here]))
            return m

        met = (along > 0).astype(float) @ dense(np.ones(len(rows))) @ (across > 0).astype(float).T
        ix, iy = np.nonzero(met > 0.5)
        out = {"ix": ix + a, "iy": iy + b}
        for v in values:
            out[v] = (along @ dense(rows[v].to_numpy(float)) @ across.T)[ix, iy]
        for v in squared:
            out[f"{v}2"] = (band(x, wide, 2) @ dense(rows[v].to_numpy(float)) @ band(y, high, 2).T)[ix, iy]
        return pd.DataFrame({k: np.repeat(rows[k].iloc[:1].to_numpy(), len(ix)) for k in keys} | out)

    return cells.groupBy(*own).applyInPandas(tile, out_schema)


def effect_map(cells: DataFrame, grid: Grid, bandwidth_km: float, truncate: float = 2.0) -> DataFrame:
    """Local effects by month and cell from components (month, year, ix, iy, num, den, n).

    theta is smoothed num over smoothed den; its error comes from year-clustered smoothed scores.  Targets are cells
    that have rows in the month.
    """
    by_cell = cells.groupBy("month", "ix", "iy").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("n").alias("rows"), F.count_distinct("year").cast("double").alias("years"))
    by_cell = by_cell.withColumn("one", F.lit(1.0)).withColumn("rows_d", F.col("rows").cast("double"))
    local = smooth(by_cell.select("month", "ix", "iy", "num", "den", "one", F.col("years").alias("w_years"), F.col("rows_d").alias("w_rows")), ["num", "den", "one", "w_years", "w_rows"], ["month"], grid, bandwidth_km, truncate, squared=["one"])
    local = local.where("den > 0").withColumn("theta", F.col("num") / F.col("den"))
    yearly = cells.groupBy("year", "month", "ix", "iy").agg(F.sum("num").alias("num"), F.sum("den").alias("den")).withColumn("one", F.lit(1.0))
    yearly = smooth(yearly, ["num", "den", "one"], ["year", "month"], grid, bandwidth_km, truncate)
    score = yearly.join(local.select("month", "ix", "iy", "theta"), ["month", "ix", "iy"]).withColumn("s", F.col("num") - F.col("theta") * F.col("den"))
    meat = score.groupBy("month", "ix", "iy").agg(F.sum(F.col("s") * F.col("s")).alias("meat"), F.count_if(F.col("one") > SUPPORT["least_weight"]).alias("g"))
    place = ["month", "ix", "iy"]
    out = by_cell.select(*place, F.col("rows").alias("target_rows"), F.col("years").cast("long").alias("target_years")).join(local, place).join(meat, place)
    var = F.when(F.col("g") > 1, F.col("g") / (F.col("g") - 1)) * F.col("meat") / (F.col("den") * F.col("den"))
    return out.select(
        *place, F.lit(float(bandwidth_km)).alias("bandwidth_km"), "target_rows", "target_years", "theta", F.sqrt(var).alias("se"), F.col("den").alias("local_den"), "g",
        F.col("one").alias("weight_sum"), F.try_divide(F.col("one") * F.col("one"), F.col("one2")).alias("effective_pixels"), F.try_divide("w_years", "one").alias("mean_years"), F.try_divide("w_rows", "one").alias("mean_rows"),
    )


def support_mask(map_rows: DataFrame, **limits: float) -> DataFrame:
    """Rows with den_cut, se_cut (quantiles by month and bandwidth) and ``supported``."""
    lim, map_rows = SUPPORT | limits, map_rows.persist()  # read by both quantiles and the join
    keys = ["month", "bandwidth_km"]
    cuts = quantile(map_rows, keys, "local_den", lim["den_q"], "den_cut").join(quantile(map_rows, keys, "se", lim["se_q"], "se_cut"), keys, "full")
    ok = (F.col("g") >= lim["years"]) & (F.col("mean_years") >= lim["mean_years"]) & (F.col("effective_pixels") >= lim["pixels"]) & (F.col("local_den") >= F.col("den_cut")) & (F.col("se") <= F.col("se_cut"))
    return map_rows.join(cuts, keys, "left").withColumn("supported", F.coalesce(ok, F.lit(False)))


def map_summary(masked: DataFrame) -> DataFrame:
    """By month and bandwidth: cells, supported cells, mean effects and the share of positive ones, weighted and not."""
    s, w = F.col("supported"), F.when(F.col("supported"), F.col("local_den"))
    return masked.groupBy("month", "bandwidth_km").agg(
        F.count("*").alias("n"), F.count_if(s).alias("n_supported"), F.avg(F.when(s, F.col("theta") * 10)).alias("effect_mean"), (F.try_divide(F.sum(w * F.col("theta")), F.sum(w)) * 10).alias("effect_weighted"),
        F.try_divide(F.count_if(s & (F.col("theta") > 0)), F.count_if(s)).alias("share_positive"),
    )


def with_intervals(map_rows: DataFrame) -> DataFrame:
    crit = t_critical(F.greatest(F.col("g") - 1, F.lit(1)).cast("double"))
    return map_rows.withColumn("_c", crit).withColumn("ci_low", (F.col("theta") - F.col("_c") * F.col("se")) * 10).withColumn("ci_high", (F.col("theta") + F.col("_c") * F.col("se")) * 10).drop("_c")


def rank_months(map_rows: DataFrame) -> DataFrame:
    """Largest absolute effect's month of each cell (ties: the earlier month)."""
    w = W.partitionBy("ix", "iy").orderBy(F.desc(F.abs("theta")), "month")
    return map_rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("ix", "iy", F.col("month").alias("peak_month"), F.col("theta").alias("peak_theta"))
