"""Corrections for many tests: Benjamini-Hochberg, Benjamini-Yekutieli and Holm.

Without groups all p values are ranked in one window.  ``bucketed_ranks`` ranks a very long column without one: counts
of range buckets are summed up first, then each bucket is ranked by itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EULER = 0.5772156649015329  # Euler's constant


def _valid(df: DataFrame, p: str) -> DataFrame:
    return df.withColumn("_p", F.when(~F.isnan(p), F.col(p)))


def bucketed_ranks(df: DataFrame, p: str, groups: list[str], buckets: int = 1024) -> DataFrame:
    """``_rank`` (equal values get the largest rank) and ``_m`` (number of values) of each row whose p is not NULL."""
    b = F.least(F.floor(F.sqrt(p) * buckets), F.lit(buckets - 1))
    d = df.withColumn("_b", b)
    per = d.where(F.col(p).isNotNull()).groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*groups).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    per = per.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_m", F.sum("_n").over(W.partitionBy(*groups))).drop("_n")
    inside = F.count(p).over(W.partitionBy(*groups, "_b").orderBy(p).rangeBetween(W.unboundedPreceding, 0))
    return d.join(per, [*groups, "_b"], "left").withColumn("_rank", F.col("_before") + inside).drop("_before")


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: summed up to 64, then by the Euler-Maclaurin formula (exact to double precision from there on)."""
    x = m.cast("double")
    short = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(m, F.lit(64))).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    return F.when(m <= 64, short).otherwise(F.log(x) + EULER + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x))


def fdr(df: DataFrame, p: str, groups: list[str] | None = None, method: str = "bh", out: str = "q") -> DataFrame:
    """Rows with q: least p * m * c / rank over the same and larger p values, at most 1; NULL and NaN p stay NULL."""
    groups = groups or []
    ranked = bucketed_ranks(_valid(df, p), "_p", groups)
    factor = F.col("_m").cast("double") * (harmonic(F.col("_m")) if method == "by" else F.lit(1.0))
    ranked = ranked.withColumn("_raw", F.when(F.col("_p").isNotNull(), F.col("_p") * factor / F.col("_rank")))
    # the least over larger values: within the bucket, then over the least of later buckets
    later = ranked.where("_p is not null").groupBy(*groups, "_b").agg(F.min("_raw").alias("_least"))
    later = later.withColumn("_later", F.min("_least").over(W.partitionBy(*groups).orderBy("_b").rowsBetween(1, W.unboundedFollowing))).drop("_least")
    own = F.min("_raw").over(W.partitionBy(*groups, "_b").orderBy("_p").rangeBetween(0, W.unboundedFollowing))
    res = ranked.withColumn("_own", own).join(later, [*groups, "_b"], "left")
    q = F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), F.col("_own"), F.coalesce("_later", F.lit(float("inf")))))
    return res.withColumn(out, q).drop("_p", "_b", "_m", "_rank", "_raw", "_own", "_later")


def holm(df: DataFrame, p: str, groups: list[str] | None = None, out: str = "p_holm") -> DataFrame:
    """Rows with the step-down p value: largest (m - i) p over the same and smaller p values, at most 1.

    For tables of tests: the groups (all rows without any) are windows.
    """
    groups = groups or []
    d = _valid(df, p).withColumn("_null", F.isnull("_p"))
    w = W.partitionBy(*groups, "_null").orderBy("_p")
    raw = (F.count("*").over(W.partitionBy(*groups, "_null")) - F.row_number().over(w) + 1) * F.col("_p")
    d = d.withColumn("_raw", raw)
    run = F.max("_raw").over(w.rangeBetween(W.unboundedPreceding, 0))
    return d.withColumn(out, F.when(~F.col("_null"), F.least(F.lit(1.0), run))).drop("_p", "_null", "_raw")


def holm_values(p: np.ndarray) -> np.ndarray:
    """The same for a short array."""
    out, ok = np.full(len(p), np.nan), np.flatnonzero(np.isfinite(p))
    order = ok[np.argsort(p[ok], kind="stable")]
    out[order] = np.minimum(1.0, np.maximum.accumulate(p[order] * np.arange(len(order), 0, -1)))
    return out
