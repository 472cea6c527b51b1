"""Correlation of residuals with distance, within a year and month.

Points are put in tiles as wide as the largest distance and meet the 3 x 3 tiles around them by an equi-join on
(year, month, tile).  With ``sample`` a cell keeps that many points, chosen by a hash of their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bin edges in km and the level that counts as zero.
BINS_KM = (0, 25, 50, 75, 100, 125, 150, 200)
NEAR_ZERO = 0.05


def pairs(points: DataFrame, reach: float, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """keys, a, b, distance of every unordered pair of points (id, x, y) at most ``reach`` apart, with both points' values (a_v, b_v)."""
    values = values or []
    tiled = points.withColumn("tx", F.floor(F.col("x") / reach)).withColumn("ty", F.floor(F.col("y") / reach))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("_around")
    left = tiled.select(*keys, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "tx", "ty", *(F.col(v).alias(f"a_{v}") for v in values))
    right = tiled.select(*keys, F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "tx", "ty", *(F.col(v).alias(f"b_{v}") for v in values), around)
    right = right.withColumn("tx", F.col("tx") + F.col("_around.i")).withColumn("ty", F.col("ty") + F.col("_around.j")).drop("_around")
    distance = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return left.join(right, [*keys, "tx", "ty"]).where("a < b").withColumn("distance", distance).where(F.col("distance") <= reach)


def sampled(points: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """At most n points a cell, by the MD5 of seed and id; first within parts of a cell, so that no task sorts a whole one."""
    lot = F.md5(F.concat_ws(":", F.lit(seed), "id"))
    d = points.withColumn("_lot", lot).withColumn("_part", F.pmod(F.crc32(F.col("id").cast("string")), F.lit(32)))
    for group in ([*keys, "_part"], keys):
        d = d.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy("_lot", "id"))).where(F.col("_r") <= n)
    return d.drop("_r", "_lot", "_part")


def bin_of(distance: Column, edges_m: list[float]) -> Column:
    """Number of the half-open bin; the last one is closed."""
    out = F.lit(None).cast("int")
    for i in range(len(edges_m) - 2, -1, -1):
        top = distance <= edges_m[i + 1] if i == len(edges_m) - 2 else distance < edges_m[i + 1]
        out = F.when((distance >= edges_m[i]) & top, i).otherwise(out)
    return out


def correlogram(points: DataFrame, variables: list[str], bins_km: tuple[float, ...] = BINS_KM, keys: tuple[str, ...] = ("year", "month"), least: int = 20, sample: int | None = None) -> DataFrame:
    """keys, variable, bin, n_pairs and the sum of products of standardised values, for cells of enough points."""
    keys, edges_m = list(keys), [1000.0 * b for b in bins_km]
    if sample:
        points = sampled(points, keys, sample)
    moments = points.groupBy(*keys).agg(F.count("*").alias("n"), *(a for v in variables for a in (F.avg(v).alias(f"m_{v}"), F.stddev_samp(v).alias(f"s_{v}"))))
    z = points.join(moments.where(F.col("n") >= least), keys).select(*keys, "id", "x", "y", *(F.when(F.col(f"s_{v}") > 0, (F.col(v) - F.col(f"m_{v}")) / F.col(f"s_{v}")).alias(v) for v in variables))
    met = pairs(z, edges_m[-1], keys, variables).withColumn("bin", bin_of(F.col("distance"), edges_m)).where("bin is not null")
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), (F.col(f"a_{v}") * F.col(f"b_{v}")).alias("product")) for v in variables))).alias("v")
    return met.select(*keys, "bin", each).where("v.product is not null").groupBy(*keys, "v.variable", "bin").agg(F.count("*").alias("n_pairs"), F.sum("v.product").alias("product_sum"))


def pooled_correlogram(by_cell: DataFrame, bins_km: tuple[float, ...] = BINS_KM) -> DataFrame:
    """variable, bin, low and high km, n_pairs, mean product over all cells."""
    low, high = (F.array(*(F.lit(float(b)) for b in edge)) for edge in (bins_km[:-1], bins_km[1:]))
    out = by_cell.groupBy("variable", "bin").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("product_sum").alias("product_sum"))
    return out.select("variable", "bin", low[F.col("bin")].alias("low_km"), high[F.col("bin")].alias("high_km"), "n_pairs", (F.col("product_sum") / F.col("n_pairs")).alias("mean_product"))


def dependence_summary(pooled: DataFrame, reference_km: float, near_zero: float = NEAR_ZERO) -> DataFrame:
    """By variable: upper end of the first of two consecutive bins near zero, and the bin nearest the block size."""
    w = W.partitionBy("variable").orderBy("low_km")
    flat = F.abs("mean_product") <= near_zero
    d = pooled.withColumn("_flat", flat & F.coalesce(F.abs(F.lead("mean_product").over(w)) <= near_zero, F.lit(False))).withColumn("_mid", (F.col("low_km") + F.col("high_km")) / 2)
    return d.groupBy("variable").agg(F.min(F.when(F.col("_flat"), F.col("high_km"))).alias("near_zero_km"), F.min_by("mean_product", F.struct(F.abs(F.col("_mid") - reference_km), "low_km")).alias("at_reference"), F.min_by("_mid", F.struct(F.abs(F.col("_mid") - reference_km), "low_km")).alias("reference_mid_km"))
