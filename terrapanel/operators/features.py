"""Design columns, within transforms and the join to next year's exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Land-cover codes by merged class.
CLASS_GROUPS = {10: (10, 11, 12, 20), 50: (50,), 60: (60, 61, 62), 70: (70, 71, 72), 80: (80, 81, 82), 90: (90,), 120: (120, 121, 122), 130: (130,)}


def time_features(df: DataFrame, first_year: int = 2000) -> DataFrame:
    """time_index, year_centered and eleven month dummies (January is the reference)."""
    return df.withColumns({"time_index": F.col("year") * 12 + F.col("month"), "year_centered": (F.col("year") - first_year).cast("double")} | {name: (F.col("month") == m).cast("double") for m, name in month_names().items()})


def month_names() -> dict[int, str]:
    return {m: f"month_{m:02d}" for m in range(2, 13)}


def month_label(month: Column) -> Column:
    return F.date_format(F.make_date(F.lit(2000), month.cast("int"), F.lit(1)), "MMM")


def class_group(code: Column) -> Column:
    """Merged class of a raw code; NULL where the code belongs to none."""
    pairs = [F.lit(v) for group, codes in CLASS_GROUPS.items() for c in codes for v in (c, group)]
    return F.try_element_at(F.create_map(*pairs), F.rint(code).cast("int"))


def one_hot(df: DataFrame, column: str, levels: list[int] | None = None, prefix: str | None = None) -> tuple[DataFrame, list[str]]:
    """Dummies of a nominal column for every level but the least; levels default to the codes in ``df``."""
    levels = sorted(levels if levels is not None else [r[0] for r in df.select(F.rint(column).cast("int").alias("v")).where("v is not null").distinct().collect()])
    names = {v: f"{prefix or column}_{v}" for v in levels[1:]}
    return df.withColumns({n: (F.rint(column) == v).cast("double") for v, n in names.items()}), list(names.values())


def subclass_dummies(df: DataFrame, column: str, group: int) -> tuple[DataFrame, list[str]]:
    return one_hot(df, column, list(CLASS_GROUPS[group]), f"sub_{column}")


def within(df: DataFrame, keys: list[str], columns: list[str], least: int = 1, count_years: bool = False, suffix: str = "_w") -> DataFrame:
    """Columns minus their mean over ``keys``, for groups of at least ``least`` rows (or years)."""
    w = W.partitionBy(*keys)
    n = F.size(F.collect_set("year").over(w)) if count_years else F.count("*").over(w)
    kept = df.withColumn("group_size", n).where(F.col("group_size") >= least)
    return kept.withColumns({f"{c}{suffix}": F.col(c) - F.avg(c).over(w) for c in columns})


def within_pixel_year(df: DataFrame, columns: list[str], pixel: str = "pixel", least: int = 6) -> DataFrame:
    """Strict within transform: pixel-years of at least ``least`` months."""
    return within(df, [pixel, "year"], columns, least)


def within_pixel_month(df: DataFrame, columns: list[str], pixel: str = "pixel", least: int = 5) -> DataFrame:
    """Interannual anomalies: pixel-months of at least ``least`` years."""
    return within(df, [pixel, "month"], columns, least)


def within_audit(df: DataFrame, keys: list[str], columns: list[str], suffix: str = "_w") -> DataFrame:
    """Largest and mean absolute group mean of each transformed column; both are 0 up to rounding."""
    means = df.groupBy(*keys).agg(*(F.abs(F.avg(f"{c}{suffix}")).alias(c) for c in columns))
    stack = F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).alias("v")) for c in columns))).alias("x")
    return means.select(stack).groupBy("x.variable").agg(F.max("x.v").alias("max_abs_mean"), F.avg("x.v").alias("mean_abs_mean"), F.count("*").alias("n_groups"))


def future_exposure(df: DataFrame, exposure: str, pixel: str = "pixel") -> DataFrame:
    """Rows with ``exposure``_next: the same pixel and month exactly one year on; rows without it are left out."""
    ahead = df.select(pixel, (F.col("year") - 1).alias("year"), "month", F.col(exposure).alias(f"{exposure}_next"))
    return df.join(ahead, [pixel, "year", "month"])


def anomaly(df: DataFrame, value: str, keys: list[str], least_years: int = 10) -> DataFrame:
    """``value``_anomaly: value minus its mean over ``keys``, where the mean rests on enough rows."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias("climatology"), F.count(value).alias("climatology_n"))
    out = df.join(mean, keys)
    return out.withColumn(f"{value}_anomaly", F.when(F.col("climatology_n") >= least_years, F.col(value) - F.col("climatology")))


def eligibility(df: DataFrame, keys: list[str], rows: int = 20_000, blocks: int = 15, folds: int = 5) -> DataFrame:
    """Cells with their support and why a cell is left out (NULL: it is not)."""
    cell = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct("block").alias("n_blocks"), F.count_distinct("fold").alias("n_folds"))
    reason = F.when(F.col("n_rows") < rows, "rows").when(F.col("n_blocks") < blocks, "blocks").when(F.col("n_folds") < folds, "folds")
    return cell.withColumn("reason", reason).withColumn("eligible", reason.isNull())


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row a key: the last in an order that must be given (ties are the caller's to break)."""
    w = W.partitionBy(*keys).orderBy(order.desc())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def in_order(df: DataFrame, key: str, names: list) -> DataFrame:
    """Rows with ``position``, the place of their key in a given list (keys that it lacks come last), in that order."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col(key))
    return df.withColumn("position", F.when(place > 0, place).otherwise(len(names) + 1).cast("int")).orderBy("position", key)


def looked_up(df: DataFrame, key: str, mapping: dict, out: str) -> DataFrame:
    """Rows with the value of a short dictionary; a key that it lacks is an error."""
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    found = F.try_element_at(pairs, F.col(key))
    return df.withColumn(out, F.when(found.isNull() & F.col(key).isNotNull(), F.raise_error(F.concat(F.lit(f"{key} without an entry: "), F.col(key).cast("string")))).otherwise(found))


def joined_once(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to rows that must be there at most once a key; a second one is an error."""
    n = F.count("*").over(W.partitionBy(*keys))
    checked = right.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one row of a key"))).otherwise(F.col("_n")))
    out = left.join(checked, keys, "left")
    return out.where(F.col("_n").isNull() | (F.col("_n") >= 1)).drop("_n")
