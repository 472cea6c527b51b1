"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round halves the depth of the trees, so rounds grow with the logarithm of a component's size; rounds go on until
nothing changes.  Edges stay in the shared folder between rounds; only their number and a checksum come to the driver.
Neighbour minima are aggregates joined back to the edges, and a hub's edges are salted, so no task gets them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import salted_join, saved


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h"), F.sum(F.xxhash64("v", "u") % 999_983).alias("g")).first()
    return (r["n"], r["h"], r["g"])


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n_edges"))
    return salted_join(both, least, "u", "n_edges", 2 * n, ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame, n: int) -> DataFrame:
    # edges point from the larger u to the smaller v
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_edges"))
    moved = salted_join(edges, least, "u", "n_edges", n, ["v"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of the edges (u, v); nodes without edges are not listed."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = saved(e, "edges")
    state = _state(e)
    while state[0]:
        # the large stars are read twice by the small ones, so they are saved as well
        e = saved(_small(saved(_large(e, state[0]), "edges"), state[0]), "edges")
        now = _state(e)
        if now == state:
            break
        state = now
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
