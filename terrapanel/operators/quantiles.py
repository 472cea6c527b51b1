"""Exact quantiles of long columns: the sought order statistics are found digit by digit, by counting alone.

A double's bits, with those of negative numbers turned over, order like the double itself.  Values are counted by their
first bits, the digit that holds each sought rank follows from running counts, and the next digits are counted among the
values that share the found ones.  Three rounds fix all 64 bits.  No value is ever sorted or gathered: heavy tails, ties and a
group with nearly all rows only make counts larger.  All keys and all quantiles share the rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import scratch

DIGITS = (24, 20, 20)  # sign, exponent and 12 bits of the mantissa first
_REST = (1 << 63) - 1


def turned(bits: Column) -> Column:
    """Bits of a double to a long that orders like it, and back."""
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(_REST))).otherwise(bits)


def with_ordered_bits(df: DataFrame, value: str, out: str) -> DataFrame:
    """A long that orders like the double (-0.0 equals 0.0)."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col(value) + F.lit(0.0)).cast("long")
    return df.withColumn(out, bits).withColumn(out, turned(F.col(out)))


def with_value(df: DataFrame, bits: str, out: str) -> DataFrame:
    """The double of its ordered bits."""
    return df.withColumn(out, F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), turned(F.col(bits))).cast("double"))


def _kept(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "ranks")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], between: bool = True) -> DataFrame:
    """keys and a column for each of ``wanted`` (name: q): quantiles, linear between neighbours, of the values that are not NULL.

    Without ``between`` it is the lower neighbour, a value that occurs.  ``df`` is read four times at once (a caller with a
    costly one keeps it before); between the reads only the sought ranks are kept.  NaN counts as the largest value, rows
    with a NULL key are left out.
    """
    v = with_ordered_bits(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), "_v", "_b").drop("_v")
    at = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(f(at(q)).cast("long")) for q in wanted.values() for f in (F.floor, F.ceil)))))
    sizes = v.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 0")
    sought = _kept(sizes.select(*keys, "_n", F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_found"), F.lit(0).cast("long").alias("_before")))
    left = 64
    for digits in DIGITS:
        own = v.withColumns({"_found": F.shiftright("_b", left) if left < 64 else F.lit(0).cast("long"), "_digit": F.shiftright("_b", left - digits)})
        if left < 64:
            own = own.join(sought.select(*keys, "_found").distinct(), [*keys, "_found"], "left_semi")
        counts = own.groupBy(*keys, "_found", "_digit").agg(F.count("*").alias("_c"))
        counts = counts.withColumn("_upto", F.sum("_c").over(W.partitionBy(*keys, "_found").orderBy("_digit")))
        place = F.col("_rank") - F.col("_before")
        met = sought.join(counts, [*keys, "_found"]).where((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_c")))
        sought = met.select(*keys, "_n", "_rank", F.col("_digit").alias("_found"), (F.col("_before") + F.col("_upto") - F.col("_c")).alias("_before"))
        sought = _kept(sought)  # two rows a key and quantile, read twice by the next round
        left -= digits
    entries = F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")
    found = with_value(sought, "_found", "_v").groupBy(*keys).agg(F.first("_n").alias("_n"), entries)

    def one(q: float) -> Column:
        low, high = F.col("_at")[F.floor(at(q)).cast("long")], F.col("_at")[F.ceil(at(q)).cast("long")]
        part = at(q) - F.floor(at(q))
        return low + (high - low) * part if between else low

    return found.select(*keys, *(one(q).alias(name) for name, q in wanted.items()))


def quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """keys and one quantile."""
    return quantiles(df, keys, value, {out: q})
