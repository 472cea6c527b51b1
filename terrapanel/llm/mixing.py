"""Temperature mixing: source shares raised to an exponent, realised as budgeted block permutations.

A source's share p of all tokens becomes the weight p^a / sum p^a.  The exponent a in [0, 1] (1: as found, 0: equal
sources) is bisected until the weights meet the target:

* ``repeats``: the flattest weights at which no source is repeated more than ``limit`` times as often as the least
  repeated one;
* ``entropy``: weights whose entropy (nats) is ``limit``, or the nearest to it that can be reached.

Each evaluation is an aggregate over the table of source totals, at several exponents at once; only the numbers
come to the driver.  The token budget is the least at which every document is used (``budget=None``), or given.

A source with target tokens T and N own tokens gets floor(T / N) whole epochs and a part of one more.  Every epoch
is a permutation of the source's documents (order of an MD5 of seed, epoch and id); the part takes documents in that
order as long as their tokens fit.  The cut is found from sums over hash blocks, then inside the one block where the
budget ends, so no source's rows ever meet in one task.  Copies are dealt over ``blocks`` blocks of the mixed stream by
their place in the source's own stream, so each block holds the target proportions.

Tokens are white-space separated words, or a column of counts (``tokens``, for instance of the token counts operator).

Defined cases: a null source is a source of its own; null or empty text has 0 tokens, and in a whole epoch takes a
copy like any document; sources without tokens get one epoch; repeated rows (equal ids) share a hash and are taken
together; null ids share one hash; an empty table gives an empty result; ``apply_mix`` returns the given columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import saved, table

LIMIT, SEED, BLOCKS, BLOCK_ROWS = 2.0, 17, 64, 2000
PROBES = 15


def draw(epoch: Column, doc_id: Column, seed: int = SEED) -> Column:
    """A 48-bit number for (epoch, id)."""
    key = F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")


def light(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokens: str | None = None) -> DataFrame:
    n = F.col(f"`{tokens}`") if tokens else F.regexp_count(F.col(f"`{text}`"), F.lit(r"\S+"))
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.coalesce(n, F.lit(0)).cast("long").alias("tokens"))


def measures(totals: DataFrame, exponents: list[float], target: str) -> dict[float, float]:
    """The target's measure at each exponent; it falls as the exponent grows."""
    a = totals.where("tokens > 0").select("p", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    power = F.pow("p", F.col("a"))
    if target == "entropy":
        z, y = F.sum(power), F.sum(power * F.log("p"))
        out = a.groupBy("a").agg((F.log(z) - F.col("a") * y / z).alias("m"))
    else:
        out = a.groupBy("a").agg((F.max(F.pow("p", F.col("a") - 1)) / F.min(F.pow("p", F.col("a") - 1))).alias("m"))
    return {r["a"]: r["m"] for r in out.collect()}  # a row an exponent


def exponent(totals: DataFrame, target: str, limit: float) -> float:
    """Bisection (PROBES points a step) for the least exponent whose measure is at most ``limit``."""
    low, high = 0.0, 1.0
    at_zero = measures(totals, [0.0], target)
    if not at_zero or at_zero[0.0] <= limit:
        return 0.0
    while high - low > 1e-13:
        probes = [low + (high - low) * (i + 1) / (PROBES + 1) for i in range(PROBES)]
        found = measures(totals, probes, target)
        for p in probes:
            if found[p] <= limit:
                high = p
                break
            low = p
    return round(high, 9)


def mix_plan(rows: DataFrame, target: str = "repeats", limit: float = LIMIT, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """source, n_tokens, weight, goal, epochs (whole) and cut (largest draw of the part epoch) from light() rows.

    ``rows`` is read several times: save it first.
    """
    sums = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    whole = sums.agg(F.sum("tokens")).first()[0] or 0
    totals = saved(sums.withColumn("p", F.col("tokens") / F.lit(float(max(1, whole)))), "source-totals")
    a = exponent(totals, target, limit)
    scale = totals.where("tokens > 0").agg(F.sum(F.pow("p", F.lit(a))).alias("z"), F.max(F.col("tokens") / F.pow("p", F.lit(a))).alias("least")).first()
    z = scale["z"] or 1.0
    tokens = budget if budget is not None else (scale["least"] or 0.0) * z
    goal = F.when(F.col("tokens") > 0, F.floor(F.lit(float(tokens)) * F.pow("p", F.lit(a)) / F.lit(z) + 0.5)).otherwise(0)
    plan = totals.withColumn("weight", F.when(F.col("tokens") > 0, F.pow("p", F.lit(a)) / F.lit(z)).otherwise(0.0)).withColumn("goal", goal.cast("long"))
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.col("tokens"))).otherwise(1).cast("int")).withColumn("rest", F.when(F.col("tokens") > 0, F.col("goal") - F.col("epochs") * F.col("tokens")).otherwise(0))
    plan = plan.withColumn("hashed", F.greatest(F.lit(1), F.ceil(F.col("documents") / BLOCK_ROWS)))
    # the part epoch: sums over hash blocks, then the block where the budget ends
    same = rows["source"].eqNullSafe(F.col("s"))
    to = plan.select(F.col("source").alias("s"), "epochs", "rest", "hashed")
    to = F.broadcast(to) if to.count() <= 100_000 else to
    drawn = rows.join(to, same).withColumn("draw", draw(F.col("epochs"), F.col("doc_id"), seed))
    drawn = drawn.select("s", "tokens", "rest", "draw", F.floor(F.col("draw") / F.lit(float(1 << 48)) * F.col("hashed")).alias("block"))
    per_block = drawn.groupBy("s", "rest", "block").agg(F.sum("tokens").alias("t"), F.max("draw").alias("last"))
    upto = F.sum("t").over(W.partitionBy("s").orderBy("block"))
    per_block = saved(per_block.withColumn("upto", upto), "mix-blocks")
    full = per_block.where("upto <= rest").groupBy("s").agg(F.max("last").alias("full_cut"))
    edge = per_block.where("upto > rest").groupBy("s").agg(F.min_by(F.struct("block", (F.col("upto") - F.col("t")).alias("before")), "block").alias("e")).select(F.col("s").alias("es"), F.col("e.block").alias("eb"), F.col("e.before").alias("before"))
    inside = drawn.join(F.broadcast(edge) if edge.count() <= 100_000 else edge, F.col("s").eqNullSafe(F.col("es")) & (F.col("block") == F.col("eb")))
    inside = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(W.partitionBy("s", "block").orderBy("draw").rangeBetween(W.unboundedPreceding, 0)))
    inside = inside.where("upto <= rest").groupBy("s").agg(F.max("draw").alias("edge_cut")).withColumnRenamed("s", "s2")
    plan = plan.join(full, F.col("source").eqNullSafe(F.col("s")), "left").join(inside, F.col("source").eqNullSafe(F.col("s2")), "left")
    cut = F.when(F.col("rest") > 0, F.greatest(F.coalesce("full_cut", F.lit(-1)), F.coalesce("edge_cut", F.lit(-1)))).otherwise(F.lit(-1)).cast("long")
    return plan.select("source", F.col("tokens").alias("n_tokens"), "weight", "goal", "epochs", cut.alias("cut"))


def copies(docs: DataFrame, plan: DataFrame, doc_id: str = "doc_id", source: str = "source", blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` once for every epoch, with mix_epoch, mix_block, mix_draw and mix_weight."""
    own = plan.select(F.col("source").alias("mix_source"), F.col("weight").alias("mix_weight"), "epochs", "cut", F.when(F.col("n_tokens") > 0, F.col("goal") / F.col("n_tokens")).otherwise(1.0).alias("mix_rate"))
    own = F.broadcast(own) if own.count() <= 100_000 else own
    d = docs.join(own, F.col(f"`{source}`").cast("string").eqNullSafe(F.col("mix_source")))
    part = draw(F.col("epochs"), F.col(f"`{doc_id}`"), seed) <= F.col("cut")
    n = F.col("epochs") + part.cast("int")
    d = d.withColumn("mix_epoch", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    d = d.withColumn("mix_draw", draw(F.col("mix_epoch"), F.col(f"`{doc_id}`"), seed))
    place = (F.col("mix_epoch") + F.col("mix_draw") / F.lit(float(1 << 48))) / F.greatest("mix_rate", F.col("mix_epoch") + F.lit(1.0) - F.when(F.col("mix_epoch") >= F.col("epochs"), F.lit(1.0) - F.col("cut") / F.lit(float(1 << 48))).otherwise(0.0))
    return d.withColumn("mix_block", F.least(F.floor(place * blocks), F.lit(blocks - 1)).cast("int")).drop("epochs", "cut", "mix_source", "mix_rate")


def apply_mix(docs: DataFrame, target: str = "repeats", limit: float = LIMIT, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """The documents repeated by the mix, in the order of its blocks and their draws; the given columns only."""
    plan = mix_plan(saved(light(docs), "mix-light"), target, limit, budget, seed)
    # rows travel as one struct, so that their columns cannot clash with the mix's
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id"), F.col("source"))
    mixed = copies(held, saved(plan, "mix-plan"), seed=seed)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), BLOCKS)
    return mixed.repartitionByRange(parts, "mix_block", "mix_draw").sortWithinPartitions("mix_block", "mix_draw").select("row.*")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(light(table(spark, sf_dir, "documents")), "mix-light")
    out = copies(rows, saved(mix_plan(rows), "mix-plan"))
    return out.select("doc_id", "source", "tokens", F.round("mix_weight", 8).alias("weight"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_draw").alias("draw"))


_DRAW = "CAST('0x' || substr(md5('{seed}:' || {epoch} || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT)"
_PART = _DRAW.format(seed=SEED, epoch="CAST(epochs AS VARCHAR)")
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '\S+')), 0) AS BIGINT) AS tokens FROM documents),
t AS (SELECT source, sum(tokens) AS n, sum(tokens) / (SELECT CAST(sum(tokens) AS DOUBLE) FROM d) AS p FROM d GROUP BY source),
a AS (SELECT greatest(0.0, round(1 - ln({LIMIT}) / nullif(ln(max(p) / min(p)), 0), 9)) AS a FROM t WHERE n > 0),
z AS (SELECT sum(pow(p, coalesce(a, 0))) AS z, max(n / pow(p, coalesce(a, 0))) AS least FROM t, a WHERE n > 0),
g AS (SELECT source, n, pow(p, coalesce(a, 0)) / z AS weight, CAST(floor(least * z * pow(p, coalesce(a, 0)) / z + 0.5) AS BIGINT) AS goal FROM t, a, z),
e AS (SELECT *, CAST(floor(goal / n) AS INTEGER) AS epochs, goal - CAST(floor(goal / n) AS BIGINT) * n AS rest FROM g),
w AS (SELECT d.*, weight, goal, n, epochs, rest, {_PART} AS part FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY part RANGE UNBOUNDED PRECEDING) AS upto FROM w),
k AS (SELECT source, CASE WHEN any_value(rest) > 0 THEN coalesce(max(part) FILTER (WHERE upto <= rest), -1) ELSE -1 END AS cut FROM c GROUP BY source),
x AS (SELECT w.*, cut, unnest(range(0, epochs + CASE WHEN part <= cut THEN 1 ELSE 0 END)) AS epoch FROM w JOIN k ON w.source IS NOT DISTINCT FROM k.source),
y AS (SELECT *, {_DRAW.format(seed=SEED, epoch="CAST(epoch AS VARCHAR)")} AS draw FROM x)
SELECT doc_id, source, tokens, round(weight, 8) AS weight, CAST(epoch AS INTEGER) AS epoch,
 CAST(least(floor((epoch + draw / 281474976710656.0) / greatest(goal / n, epoch + 1.0 - CASE WHEN epoch >= epochs THEN 1.0 - cut / 281474976710656.0 ELSE 0.0 END) * {BLOCKS}), {BLOCKS} - 1) AS INTEGER) AS block, draw
FROM y
"""
