"""The panel: a row a pixel and month, with an outcome, an exposure and covariates.

Readers select and cast the wanted columns in the scan, so Parquet and CSV sources prune columns and push filters.
Missing values are NULL throughout: NaN and infinities are turned into NULL at the source.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOME, EXPOSURE = "sif", "o3"
CONTROLS_A = ("dem", "lccs", "t2m", "ssrd", "tp", "u10", "v10", "sp", "stl1", "swvl1")
CONTROLS_B = (*CONTROLS_A, "stl2", "stl3", "stl4", "stl5", "swvl2", "swvl3", "swvl4", "swvl5", "ssr", "str", "src", "pev")
CONTROLS_C = (*CONTROLS_B, "lai_hv", "lai_lv", "evavt", "e")
COMPONENT_COLUMNS = ("year", "month", "pixel_id", "spatial_block", "x", "y", "numerator_raw", "denominator_raw", "n_obs")


@dataclass(frozen=True)
class PanelSchema:
    """Which columns a panel must and may have; ``strict`` makes missing covariates an error instead of dropping them."""

    covariates: tuple[str, ...] = CONTROLS_A
    outcome: str = OUTCOME
    exposure: str = EXPOSURE
    strict: bool = False
    aliases: dict[str, str] = field(default_factory=dict)

    def present(self, columns: list[str]) -> dict[str, str]:
        """Wanted name -> name in the source (matched without case)."""
        there = {c.lower(): c for c in columns}
        found = {}
        for name in ("x", "y", "year", "month", self.outcome, self.exposure, *self.covariates):
            for option in (name, self.aliases.get(name, name)):
                if option.lower() in there:
                    found[name] = there[option.lower()]
                    break
        needed = {"x", "y", "year", "month", self.outcome, self.exposure} | (set(self.covariates) if self.strict else set())
        if missing := sorted(needed - set(found)):
            raise ValueError(f"panel lacks columns: {', '.join(missing)}")
        return found


def finite(c: Column) -> Column:
    """The value as double; NULL for NaN and infinities."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def normalised(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def complete_cases(df: DataFrame, *columns: str) -> DataFrame:
    return normalised(df, *columns).dropna(subset=list(columns))


def month_number(c: Column) -> Column:
    """1 to 12 from a number or a text that ends in one or two digits; else NULL."""
    m = F.regexp_extract(F.trim(c.cast("string")), r"(\d{1,2})(?:\.0+)?$", 1).try_cast("int")
    return F.when(m.between(1, 12), m)


def read_panel(spark: SparkSession, path: str, schema: PanelSchema | None = None, format: str = "parquet", years: tuple[int, int] = (2000, 2022), unique: bool = True) -> DataFrame:
    """A panel from Parquet or CSV files: wanted columns only, cast, years filtered, months and (``unique``) keys checked."""
    schema = schema or PanelSchema()
    raw = spark.read.option("header", True).csv(path) if format == "csv" else spark.read.format(format).load(path)
    names = schema.present(raw.columns)
    year = F.col(f"`{names['year']}`").cast("int")
    df = raw.where(year.between(*years)).select(
        *(finite(F.col(f"`{names[c]}`")).alias(c) for c in ("x", "y")),
        year.alias("year"), month_number(F.col(f"`{names['month']}`")).alias("month"),
        *(finite(F.col(f"`{src}`")).alias(c) for c, src in names.items() if c not in ("x", "y", "year", "month")),
    )
    df = df.withColumn("month", F.when(F.col("month").isNull(), F.raise_error(F.lit("month out of 1..12"))).otherwise(F.col("month")))
    return require_unique(df) if unique else df


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count; a valid panel has none."""
    keys = keys or ("x", "y", "year", "month")
    return df.groupBy(*keys).count().where("count > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    if bad := duplicate_keys(df, *keys).limit(5).collect():
        raise ValueError(f"duplicate panel keys, for instance {bad}")
    return df


def read_components(spark: SparkSession, path: str, columns: tuple[str, ...] = COMPONENT_COLUMNS) -> DataFrame:
    """A component table; ``block`` is accepted for ``spatial_block``."""
    df = spark.read.parquet(path)
    if "spatial_block" not in df.columns and "block" in df.columns:
        df = df.withColumnRenamed("block", "spatial_block")
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"component table lacks columns: {', '.join(missing)}")
    return df.select(*columns)


def read_layers(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """Raster layers as long pixel tables (layer, year, month, ix, iy, x, y, value) with the file each row came from."""
    return spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).parquet(path).withColumn("file_name", F.col("_metadata.file_name"))


def stamp_from_name(name: Column) -> dict[str, Column]:
    """year and month from a file name that carries YYYYDDD."""
    stamp = F.regexp_extract(name, r"(\d{7})", 1)
    day = F.date_add(F.make_date(F.substring(stamp, 1, 4).try_cast("int"), F.lit(1), F.lit(1)), F.substring(stamp, 5, 3).try_cast("int") - 1)
    return {"year": F.year(day), "month": F.month(day)}


def extents(spark: SparkSession, path: str, columns: list[str]) -> dict[str, tuple]:
    """(least, largest) of columns and the number of rows (``*``) from the footers of Parquet files: no page is read.

    The aggregate is pushed into Spark's newer Parquet reader, which is chosen for this one job.
    """
    wanted = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        r = spark.read.parquet(path).agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max))).first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return {c: (r[f"min_{c}"], r[f"max_{c}"]) for c in columns} | {"*": (r["n"],)}
