"""Raster layers as pixel tables: masking, averaging, regridding, clipping and the monthly layer match."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.crs import converted, parsed
from ..functions.grid import Albers, Grid, cell_index, inside
from ..sources.sinks import scratch


def masked(df: DataFrame, value: str = "value") -> DataFrame:
    """Negative, NaN and infinite values become NULL."""
    v = F.col(value)
    return df.withColumn(value, F.when((v >= 0) & ~F.isnan(v) & (v < float("inf")), v))


def time_mean(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean of the present values of each cell; cells without any stay out."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("n"))


def nearest(targets: DataFrame, source: DataFrame, grid: Grid, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Target places (x, y) with the value of the source cell they fall in (half cells to the even index)."""
    ix, iy = cell_index(grid)
    t = targets.withColumn("ix", ix).withColumn("iy", iy).where(inside(grid, F.col("ix"), F.col("iy")))
    return t.join(source.select(*(keys or []), "ix", "iy", value), [*(keys or []), "ix", "iy"], "left")


def mode_resample(df: DataFrame, factor: int, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Most frequent value of factor x factor cells; ties go to the smallest value.

    Counted by (cell, value) first, so a cell's rows never meet in one group.
    """
    keys = keys or []
    to = df.where(F.col(value).isNotNull()).select(*keys, F.floor(F.col("ix") / factor).alias("ix"), F.floor(F.col("iy") / factor).alias("iy"), value)
    counts = to.groupBy(*keys, "ix", "iy", value).count()
    return counts.groupBy(*keys, "ix", "iy").agg(F.max_by(value, F.struct("count", (-F.col(value)).alias("v"))).alias(value))


def edges_of(ring: DataFrame) -> DataFrame:
    """Edges (x1, y1, x2, y2) from vertices (ring_id, seq, x, y)."""
    w = W.partitionBy("ring_id").orderBy("seq")
    first = W.partitionBy("ring_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return ring.select("ring_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce(F.lead("x").over(w), F.first("x").over(first)).alias("x2"), F.coalesce(F.lead("y").over(w), F.first("y").over(first)).alias("y2"))


def scanlines(ring: DataFrame, grid: Grid) -> DataFrame:
    """Runs (iy, first, last) of the grid's cells that the polygon touches: runs inside by centre lines, runs along edges.

    ``grid`` has the centre of its first cell; even-odd rule over all rings, so holes are rings like others.  Every edge is
    listed under the rows it passes, and a row's crossings are paired in their order: the work grows with the rows that edges
    span, no cell is looked at and nothing is broadcast.  Runs of a row may overlap.
    """
    edges = edges_of(ring)
    row = lambda y, shift: (y - grid.y0) / grid.dy + shift
    cell = lambda x, shift: (x - grid.x0) / grid.dx + shift
    x1, y1, x2, y2 = map(F.col, ("x1", "y1", "x2", "y2"))
    low_y, high_y, low_x, high_x = F.least(y1, y2), F.greatest(y1, y2), F.least(x1, x2), F.greatest(x1, x2)
    listed = edges.withColumns({"_low": F.greatest(F.lit(0), F.ceil(row(low_y, -0.5))), "_high": F.least(F.lit(grid.ny - 1), F.floor(row(high_y, 0.5)))}).where("_low <= _high").withColumn("iy", F.explode(F.sequence("_low", "_high")))
    centre = F.lit(grid.y0) + F.col("iy") * grid.dy
    # what of an edge lies in its row
    at = lambda y: x1 + (y - y1) * (x2 - x1) / F.when(y1 != y2, y2 - y1)
    ends = [F.coalesce(at(F.greatest(low_y, centre - grid.dy / 2)), low_x), F.coalesce(at(F.least(high_y, centre + grid.dy / 2)), high_x)]
    along = listed.select("iy", F.ceil(cell(F.greatest(low_x, F.least(*ends)), -0.5)).alias("first"), F.floor(cell(F.least(high_x, F.greatest(*ends)), 0.5)).alias("last"))
    # crossings of the row's centre line, in pairs
    crossed = listed.where((y1 > centre) != (y2 > centre)).select("iy", ((x2 - x1) * (centre - y1) / (y2 - y1) + x1).alias("c"))
    w = W.partitionBy("iy").orderBy("c")
    pairs = crossed.withColumns({"r": F.row_number().over(w), "d": F.lead("c").over(w)}).where("r % 2 = 1")
    within = pairs.select("iy", F.ceil(cell(F.col("c"), 0.0)).alias("first"), (F.ceil(cell(F.col("d"), 0.0)) - 1).alias("last"))
    runs = along.unionByName(within)
    return runs.select("iy", F.greatest(F.lit(0), "first").alias("first"), F.least(F.lit(grid.nx - 1), "last").alias("last")).where("first <= last")


def clipped(cells: DataFrame, ring: DataFrame, dx: float, dy: float) -> DataFrame:
    """Cells whose rectangle the polygon touches: the centre is inside, or an edge meets the rectangle."""
    s = cells.agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("ix", "iy")), F.min(F.col("x") - F.col("ix") * dx).alias("x0"), F.min(F.col("y") - F.col("iy") * dy).alias("y0")).first()
    if s["min_ix"] is None:
        return cells
    ix, iy = s["min_ix"], s["min_iy"]
    runs = scanlines(ring, Grid(dx, dy, s["x0"] + ix * dx, s["y0"] + iy * dy, s["max_ix"] - ix + 1, s["max_iy"] - iy + 1))
    touched = runs.select((F.col("iy") + iy).alias("iy"), F.explode(F.sequence(F.col("first") + ix, F.col("last") + ix)).alias("ix")).distinct()
    return cells.join(touched, ["ix", "iy"], "left_semi")


def match_layers(base: DataFrame, layers: dict[str, tuple[DataFrame, list[str]]], complete: bool = True) -> DataFrame:
    """The base layer's cells with every other layer joined on its own keys (monthly, yearly or static).

    ``complete`` leaves out cells with any missing value.
    """
    out = base
    for name, (layer, keys) in layers.items():
        out = out.join(layer.select(*keys, F.col("value").alias(name)), keys, "left")
    return out.dropna() if complete else out


def merged_layers(parts: list[DataFrame], keys: list[str], value: str = "value") -> DataFrame:
    """One layer from several; on cells in more than one the first of the list wins."""
    tagged = None
    for i, p in enumerate(parts):
        own = p.select(*keys, value, F.lit(i).alias("_i"))
        tagged = own if tagged is None else tagged.unionByName(own)
    return tagged.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, "_i").alias(value))


WGS84 = "EPSG:4326"


def located(layer: DataFrame, crs: str | None = None) -> DataFrame:
    """The layer with a ``crs`` column; without any it counts as longitude and latitude."""
    return layer if "crs" in layer.columns else layer.withColumn("crs", F.lit(crs or WGS84))


def warped(stack: DataFrame, source: Grid, source_crs: str | None, template: DataFrame, template_crs: str | None) -> DataFrame:
    """The template's cells (ix, iy, x, y) with all columns of the stack at the source cell that each centre falls in.

    Every target is mapped back to the source, so no target stays empty that has a source cell under it; the one shuffle is
    an equi-join on that cell, for all layers of the stack (ix, iy and columns, a row a cell or a cell and time) at once.
    """
    ix, iy = cell_index(source, "_x", "_y")
    places = converted(template, parsed(template_crs), parsed(source_crs), out=("_x", "_y")).withColumns({"_ix": ix, "_iy": iy}).where(inside(source, F.col("_ix"), F.col("_iy")))
    layers = [c for c in stack.columns if c not in ("ix", "iy", "x", "y")]
    met = places.join(stack.select(F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), *layers), ["_ix", "_iy"])
    return met.drop("_x", "_y", "_ix", "_iy")


def bucketed_layers(layers: dict[str, tuple[DataFrame, list[str]]], buckets: int) -> dict[str, tuple[DataFrame, list[str]]]:
    """Layers (with their keys, which hold ix and iy) kept as tables of equal buckets of cells: matching them needs no shuffle.

    The tables lie in the session's shared folder.  Spark must be content with buckets of fewer columns than a join has keys, so
    ``spark.sql.requireAllClusterKeysForCoPartition`` is switched off.
    """
    out = {}
    for name, (layer, keys) in layers.items():
        spark, named = layer.sparkSession, f"layer_{uuid.uuid4().hex}"
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        layer.repartition(buckets, "ix", "iy").write.bucketBy(buckets, "ix", "iy").sortBy("ix", "iy").option("path", scratch(spark, name)).saveAsTable(named)
        out[name] = (spark.table(named), keys)
    return out


def reprojected(layer: DataFrame, albers: Albers, name: str = "albers") -> DataFrame:
    """x and y of rows in longitude and latitude turned into the projection's metres; rows that are in it stay."""
    rows = located(layer)
    there, (px, py) = F.col("crs") == name, albers.forward(F.col("x"), F.col("y"))
    known = F.when(there | (F.col("crs") == WGS84), F.lit(name)).otherwise(F.raise_error(F.concat(F.lit("no projection from "), F.col("crs"))))
    return rows.withColumns({"x": F.when(there, F.col("x")).otherwise(px), "y": F.when(there, F.col("y")).otherwise(py), "crs": known})
