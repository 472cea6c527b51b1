"""Panels built from the order tables, and the SQL that builds the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Grid, block_id, grid_of
from ..operators.folds import chunk_folds, dense_folds
from ..sources.sinks import kept

STEP = 5000.0
#: Land-cover codes dealt to pixels.
CODES = (10, 11, 12, 20, 50, 60, 61, 62, 70, 90, 120, 130)
FACTOR, FOLDS = 2, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measures() -> list[Column]:
    """Outcome, exposure and covariates of a cell of line items."""
    return [
        (F.avg("l_extendedprice") / 1000).alias("sif"), F.avg("l_quantity").alias("o3"), (F.avg("l_tax") * 100).alias("t2m"),
        (F.avg("l_discount") * 100).alias("ssrd"), F.stddev_samp("l_quantity").alias("tp"), F.count("*").alias("n_rows"),
    ]


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier x year x month cells on a grid five pixels wide."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_tax", "l_discount")
    cells = li.groupBy(F.col("l_suppkey").alias("pixel"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(*measures())
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("pixel") % 12 + 1).cast("int"))
    return cells.withColumns({"x": (F.col("pixel") % 5) * STEP, "y": F.floor(F.col("pixel") / 5) * STEP, "lccs": code})


def grid_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation x part size x year x month cells; line items, the longest table, are shuffled by order alone where parts are few."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_tax", "l_discount")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    rows = li.join(o.join(c, "o_custkey"), "l_orderkey").join(p, "l_partkey")
    cells = rows.groupBy(F.col("c_nationkey").alias("ix"), F.col("p_size").alias("iy"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(*measures())
    return cells.withColumns({"x": F.col("ix") * STEP, "y": F.col("iy") * STEP, "pixel": (F.col("ix") * 1000 + F.col("iy")).cast("long")})


def kept_grid(spark: SparkSession, sf_dir: str, *measures: str) -> DataFrame:
    """The grid panel with the named measures, made once for queries that read it several times (cells of a bounded grid and months)."""
    return kept(grid_panel(spark, sf_dir).select("ix", "iy", "year", "month", "x", "y", "pixel", *measures), "grid-panel")


def with_blocks(panel: DataFrame, factor: int = FACTOR, grid: Grid | None = None) -> DataFrame:
    return panel.withColumn("block", block_id(grid or grid_of(panel), factor))


def with_folds(panel: DataFrame, k: int = FOLDS) -> DataFrame:
    """Block, spatial fold and contiguous time fold of every row."""
    return panel.join(F.broadcast(dense_folds(panel, "block", k)), "block").join(F.broadcast(chunk_folds(panel, "year", k)), "year")


def supplier_rows(spark: SparkSession, sf_dir: str, factor: int = FACTOR, measures: list[str] | None = None) -> DataFrame:
    """Supplier cells with blocks and folds; with ``measures`` the panel has those only and is made once."""
    panel = supplier_panel(spark, sf_dir)
    if measures is not None:
        panel = kept(panel.select("pixel", "year", "month", "x", "y", "lccs", *measures), "supplier-panel")
    return with_folds(with_blocks(panel, factor, Grid(STEP, STEP, 0.0, 0.0)))


def grid_rows(spark: SparkSession, sf_dir: str, factor: int = 5) -> DataFrame:
    return with_folds(with_blocks(kept_grid(spark, sf_dir, "sif", "o3", "t2m", "n_rows"), factor, Grid(STEP, STEP, 0.0, STEP)))


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded, so that the order of sums does not show."""
    return df.select(*(F.round(F.col(c), special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ---------------------------------------------------------------- SQL

_MEASURES = "avg(l_extendedprice) / 1000 AS sif, avg(l_quantity) AS o3, avg(l_tax) * 100 AS t2m, avg(l_discount) * 100 AS ssrd, stddev_samp(l_quantity) AS tp, count(*) AS n_rows"


def supplier_sql(factor: int = FACTOR) -> str:
    """CTEs p (panel) and f (with block, fold and tfold)."""
    return f"""
p AS (SELECT l_suppkey AS pixel, (l_suppkey % 5) * 5000.0::DOUBLE AS x, floor(l_suppkey / 5) * 5000.0::DOUBLE AS y, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
 {list(CODES)}[CAST(l_suppkey % 12 AS INT) + 1] AS lccs, {_MEASURES} FROM lineitem GROUP BY l_suppkey, year(l_shipdate), month(l_shipdate)),
{folds_sql(factor)}"""


def grid_sql(factor: int = 5) -> str:
    return f"""
p AS (SELECT c_nationkey AS ix, p_size AS iy, c_nationkey * 5000.0::DOUBLE AS x, p_size * 5000.0::DOUBLE AS y, CAST(c_nationkey * 1000 + p_size AS BIGINT) AS pixel, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
 {_MEASURES} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY c_nationkey, p_size, year(l_shipdate), month(l_shipdate)),
{folds_sql(factor, 0.0, STEP)}"""


def folds_sql(factor: int, x0: float = 0.0, y0: float = 0.0) -> str:
    return f"""
pb AS (SELECT *, CAST(floor((x - {x0}) / {STEP * factor}) * 10000000 + floor((y - {y0}) / {STEP * factor}) AS BIGINT) AS block FROM p),
bf AS (SELECT block, CAST((dense_rank() OVER (ORDER BY block) - 1) % {FOLDS} AS INT) AS fold FROM (SELECT DISTINCT block FROM pb)),
yf AS (SELECT year, CAST(ntile({FOLDS}) OVER (ORDER BY year) - 1 AS INT) AS tfold FROM (SELECT DISTINCT year FROM pb)),
f AS (SELECT pb.*, fold, tfold FROM pb JOIN bf USING (block) JOIN yf USING (year))"""


def oof_sql(name: str, source: str, strata: list[str], control: str = "t2m", targets: dict[str, str] | None = None, kind: str = "spatial") -> str:
    """CTE ``name``: source rows with hats and residuals of least squares on one control, by closed form."""
    targets = targets or {"d": "o3", "r": "sif"}
    cell = ["fold", "tfold"] if kind == "both" else ["fold"]
    tests = ["test", "ttest"] if kind == "both" else ["test"]
    s = "".join(f"{c}, " for c in strata)
    sums = ["count(*) AS n", f"sum({control}) AS c1", f"sum({control} * {control}) AS c2", *(q for t in targets for q in (f"sum({targets[t]}) AS t_{t}", f"sum({control} * {targets[t]}) AS ct_{t}"))]
    names = ["n", "c1", "c2", *(q for t in targets for q in (f"t_{t}", f"ct_{t}"))]
    grid = f"(SELECT unnest(range({FOLDS})) AS test) a" + (f", (SELECT unnest(range({FOLDS})) AS ttest) b" if kind == "both" else "")
    differs = "fold <> test" + (" AND tfold <> ttest" if kind == "both" else "")
    slopes = ", ".join(f"(n * ct_{t} - c1 * t_{t}) / nullif(n * c2 - c1 * c1, 0) AS b_{t}" for t in targets)
    levels = ", ".join(f"(t_{t} - b_{t} * c1) / n AS a_{t}, b_{t}" for t in targets)
    on = " AND ".join([*(f"x.{c} = m.{c}" for c in strata), *(f"x.{c} = m.{t}" for c, t in zip(cell, tests, strict=True))])
    out = ", ".join(f"a_{t} + b_{t} * x.{control} AS {targets[t]}_hat, x.{targets[t]} - (a_{t} + b_{t} * x.{control}) AS {t}" for t in targets)
    return f"""
{name}_c AS (SELECT {s}{', '.join(cell)}, {', '.join(sums)} FROM {source} GROUP BY {s}{', '.join(cell)}),
{name}_t AS (SELECT {s}{', '.join(tests)}, {', '.join(f'sum({q}) AS {q}' for q in names)} FROM {name}_c, {grid} WHERE {differs} GROUP BY {s}{', '.join(tests)}),
{name}_b AS (SELECT *, {slopes} FROM {name}_t),
{name}_m AS (SELECT {s}{', '.join(tests)}, {levels} FROM {name}_b WHERE n >= 2),
{name} AS (SELECT x.*, {out} FROM {source} x JOIN {name}_m m ON {on})"""


def components_sql(name: str, source: str, keys: list[str], d: str = "d", r: str = "r") -> str:
    k = ", ".join(keys)
    return f"{name} AS (SELECT {k}, sum({d} * {r}) AS num, sum({d} * {d}) AS den, count(*) AS n FROM {source} GROUP BY {k})"


def two_way_sql(name: str, comp: str, strata: list[str], c1: str, c2: str, small: bool = True) -> str:
    """CTE ``name``: strata, theta, se, fallback, g1, g2, g12, num, den, n."""
    k = ", ".join(strata) if strata else "_all"
    base = f"(SELECT *, 1 AS _all FROM {comp})"
    fac = lambda g: f"CASE WHEN {g} > 1 THEN {g} / ({g} - 1.0) ELSE 1.0 END" if small else "1.0"
    meat = lambda keys, i: f"{name}_m{i} AS (SELECT {k}, sum(s * s) AS m{i}, count(*) AS g{i} FROM (SELECT {k}, {keys}, sum(s) AS s FROM {name}_s GROUP BY {k}, {keys}) GROUP BY {k})"
    v = f"(m1 * {fac('g1')} + m2 * {fac('g2')} - m12 * {fac('g12')}) / (den * den)"
    w = f"greatest(m1 * {fac('g1')}, m2 * {fac('g2')}) / (den * den)"
    return f"""
{name}_a AS (SELECT {k}, {c1}, {c2}, sum(num) AS num, sum(den) AS den, sum(n) AS n FROM {base} GROUP BY {k}, {c1}, {c2}),
{name}_h AS (SELECT {k}, sum(num) / sum(den) AS theta, sum(num) AS num, sum(den) AS den, CAST(sum(n) AS BIGINT) AS n FROM {name}_a GROUP BY {k}),
{name}_s AS (SELECT a.*, a.num - h.theta * a.den AS s FROM {name}_a a JOIN {name}_h h USING ({k})),
{meat(c1, 1)}, {meat(c2, 2)}, {meat(f'{c1}, {c2}', 12)},
{name} AS (SELECT *, NOT ({v} > 0) AS fallback, sqrt(CASE WHEN {v} > 0 THEN {v} ELSE {w} END) AS se FROM {name}_h JOIN {name}_m1 USING ({k}) JOIN {name}_m2 USING ({k}) JOIN {name}_m12 USING ({k}))"""
