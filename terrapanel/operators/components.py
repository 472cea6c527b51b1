"""Additive components of an effect: sums of d*r and d*d by stratum and block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(rows: DataFrame, keys: list[str], d: str = "d", r: str = "r", **more) -> DataFrame:
    """keys, num, den, n: one partial and one final aggregate; further aggregates by name."""
    return rows.groupBy(*keys).agg(F.sum(F.col(d) * F.col(r)).alias("num"), F.sum(F.col(d) * F.col(d)).alias("den"), F.count("*").alias("n"), *(c.alias(k) for k, c in more.items()))


def merged(comp: DataFrame, keys: list[str]) -> DataFrame:
    """Components of coarser keys."""
    return comp.groupBy(*keys).agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("n").alias("n"))


def score_cells(comp: DataFrame, strata: str, cells: list[str]) -> DataFrame:
    """A row a cell with a score column for each stratum, 0 where a cell has none (scores at the stratum's effect)."""
    total = comp.groupBy(strata).agg((F.sum("num") / F.sum("den")).alias("theta"))
    scored = comp.join(total, strata).withColumn("score", F.col("num") - F.col("theta") * F.col("den"))
    return scored.groupBy(*cells).pivot(strata).agg(F.sum("score")).fillna(0.0)
