"""Random search of learner settings under blocked cross-validation (space or time held out)."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch
from . import boosted
from .crossfit import coefficients, cross_products, predicted, solve
from .folds import Split


#: The searched range of each setting of the boosted trees and its scale.
RANGES = {
    "trees": ("whole", 300, 1200),
    "depth": ("whole", 3, 10),
    "rate": ("log", 0.01, 0.15),
    "least_rows": ("whole", 1, 30),
    "least_gain": ("even", 0.0, 5.0),
    "row_share": ("even", 0.65, 1.0),
    "column_share": ("even", 0.65, 1.0),
    "l1": ("log", 1e-4, 10**0.5),
    "l2": ("log", 0.1, 30.0),
}


def candidates(n: int, seed: int = 42, ranges: dict[str, tuple] | None = None) -> list[dict]:
    """A seeded Latin hypercube: each setting's range is cut in n parts, and every part is drawn once, in its own shuffled order."""
    table: dict[str, list] = {}
    for name, (scale, low, high) in (ranges or RANGES).items():
        own = np.random.default_rng([seed, *name.encode()])
        u = (own.permutation(n) + own.random(n)) / n
        value = low * (high / low) ** u if scale == "log" else low + (high - low) * u
        table[name] = [int(v) for v in np.minimum(np.floor(low + (high + 1 - low) * u), high)] if scale == "whole" else [float(v) for v in value]
    return [{name: values[i] for name, values in table.items()} for i in range(n)]


def ridge_search(df: DataFrame, target: str, controls: list[str], penalties: list[float], k: int = 5) -> DataFrame:
    """penalty, rmse_mean, rmse_std (0 for one fold), mae_mean, r2_mean, n_folds: blocked folds with ``fold`` or ``tfold`` held out."""
    split, out = Split("either", k), None
    used = df.dropna(subset=[target, *controls])
    for penalty in penalties:  # a short list of settings; each is one job over summed cross products
        rows = predicted(used, coefficients(used, [target], controls, split, [], penalty), [target], controls, split, [])
        y, p = F.col(target), F.col(f"{target}_hat")
        per = rows.groupBy("test").agg(F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"), (1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y))).alias("r2"))
        one = per.agg(F.avg("rmse").alias("rmse_mean"), F.coalesce(F.stddev_samp("rmse"), F.lit(0.0)).alias("rmse_std"), F.avg("mae").alias("mae_mean"), F.avg("r2").alias("r2_mean"), F.count("*").alias("n_folds")).withColumn("penalty", F.lit(float(penalty)))
        out = one if out is None else out.unionByName(one)
    return out.select("penalty", "rmse_mean", "rmse_std", "mae_mean", "r2_mean", "n_folds")


def best(scores: DataFrame, name: str = "penalty") -> DataFrame:
    """The setting with the least mean error; then the least spread, then the smallest setting."""
    return scores.agg(F.min_by(F.struct(*scores.columns), F.struct("rmse_mean", "rmse_std", name)).alias("x")).select("x.*")


NO_FIT = {"rmse": math.nan, "mae": math.nan, "r2": math.nan, "n": 0}


def ridge_scores(train: DataFrame, test: DataFrame, target: str, controls: list[str], penalty: float) -> dict[str, float]:
    """rmse, mae, r2 and n of one ridge fit on rows it has not seen."""
    found = cross_products(train.withColumn("_one", F.lit(0)), ["_one"], [*controls, target]).first()
    beta = None if found is None else solve(np.asarray(found["products"], float), len(controls), 1, penalty)
    if beta is None:
        return NO_FIT
    hat = F.lit(float(beta[0, 0]))
    for b, c in zip(beta[0, 1:], controls, strict=True):
        hat = hat + F.lit(float(b)) * F.col(c)
    y, p = F.col(target), hat
    r = test.agg(F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"), F.when(F.var_pop(y) > 0, 1 - F.avg((y - p) * (y - p)) / F.var_pop(y)).alias("r2"), F.count("*").alias("n")).first()
    return {k: math.nan if v is None else v for k, v in r.asDict().items()}


Job = tuple[tuple, str, int | None, int, dict]  # name, target, outer fold, held label, setting


def tree_scores(rows: DataFrame, controls: list[str], jobs: list[Job], k: int, seed: int) -> dict[tuple, dict[str, float]]:
    """Scores of all jobs' boosted trees, grown together by depth; a job trains on rows that are in neither of its labels."""
    free = lambda label, f, t: label is None or (f != label and t != label)
    cells = [(f, t) for f in range(k) for t in range(k)]
    targets = list(dict.fromkeys(j[1] for j in jobs))
    jobs = sorted(jobs, key=lambda j: (j[4].get("depth", 0), j[4].get("trees", 0)))
    plan = [boosted.Model(targets.index(t), np.array([free(o, *c) and free(label, *c) for c in cells]), setting) for _, t, o, label, setting in jobs]
    held = [np.array([(o is None or free(o, *c)) and not free(label, *c) for c in cells]) for _, _, o, label, _ in jobs]
    own = rows.withColumns({"_code": F.lit(0), "_cell": F.col("fold") * k + F.col("tfold")})
    out = {}
    for _, entries, group in boosted.grown(own, controls, targets, plan, 1, seed):
        for p, score in group.scores([held[e] for e in entries]).items():
            out[jobs[entries[p]][0]] = score if group.count[p] else NO_FIT
    return out


def nested_search(df: DataFrame, stages: dict[str, str], controls: list[str], settings, k: int = 5, inner: int = 4, seed: int = 42, parallel: int = 8) -> dict[str, DataFrame]:
    """Settings chosen on inner folds of each outer training set, scored on the outer fold, and chosen once more on all rows.

    ``stages`` names the targets, ``settings(seed)`` gives the candidates of one search.  A label is held out in space and
    time (fold or tfold); the inner labels are the first ``inner`` of those not held out already.  Boosted trees of all searches grow
    together, ridge fits (settings with ``penalty``) run ``parallel`` at a time.  Tables: ``search`` (a row a search and
    candidate; outer is NULL for the final search), ``outer``, ``summary``, ``final``.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    spark, at = df.sparkSession, scratch(df.sparkSession, "tuning")
    df.dropna(subset=[*stages.values(), *controls]).select("fold", "tfold", *dict.fromkeys([*stages.values(), *controls])).write.parquet(f"{at}/rows")
    rows = spark.read.parquet(f"{at}/rows")
    held = lambda label: (F.col("fold") == label) | (F.col("tfold") == label)
    sizes = [(r["fold"], r["tfold"]) for r in rows.select("fold", "tfold").distinct().collect()]  # k x k cells
    usable = lambda outer, label: any(label in c and outer not in c for c in sizes) and any(label not in c and outer not in c for c in sizes)
    outers = [f for f in range(k) if usable(None, f)]
    if len(outers) < 2:
        raise ValueError("fewer than two usable outer folds")
    plan: dict[tuple, list[dict]] = {}
    work: list[Job] = []
    for outer in [*outers, None]:
        for stage, target in stages.items():
            plan[outer, stage] = settings(boosted.seed_of(seed, outer, stage) % 2**31)
            labels = [f for f in range(k) if f != outer and usable(outer, f)][:inner]
            if not labels:
                raise ValueError(f"no usable inner fold in outer fold {outer}")
            work += [((outer, stage, c, label), target, outer, label, setting) for c, setting in enumerate(plan[outer, stage]) for label in labels]

    def scored_jobs(jobs: list[Job]) -> dict[tuple, dict[str, float]]:
        ridge = [j for j in jobs if "penalty" in j[4]]

        def one(job: Job) -> tuple:
            name, target, outer, label, setting = job
            known = rows if outer is None else rows.where(~held(outer))
            return name, ridge_scores(known.where(~held(label)), known.where(held(label)), target, controls, setting["penalty"])

        with ThreadPool(parallel) as pool:
            out = dict(pool.map(inheritable_thread_target(spark)(one), ridge, 1))
        trees = [j for j in jobs if "penalty" not in j[4]]
        return out | (tree_scores(rows, controls, trees, k, seed) if trees else {})

    by_label = scored_jobs(work)
    scored: dict[tuple, list[dict]] = {}
    for job in work:
        scored.setdefault(job[0][:3], []).append(by_label[job[0]])
    spread = lambda v: float(np.std(v, ddof=1)) if len(v) > 1 else 0.0
    mean = {n: (float(np.mean([x["rmse"] for x in v])), spread([x["rmse"] for x in v]), float(np.mean([x["mae"] for x in v])), float(np.mean([x["r2"] for x in v])), len(v)) for n, v in scored.items()}
    chosen = {s: min((m[0] if m[0] == m[0] else math.inf, m[1], n[2]) for n, m in mean.items() if n[:2] == s)[2] for s in plan}
    final = scored_jobs([((o, s), stages[s], None, o, plan[o, s][c]) for (o, s), c in chosen.items() if o is not None])
    confirmed = [(o, s, chosen[o, s], _text(plan[o, s][chosen[o, s]]), x["n"], x["rmse"], x["mae"], x["r2"]) for (o, s), x in final.items()]
    search = [(o, s, c, _text(plan[o, s][c]), *m, chosen[o, s] == c) for (o, s, c), m in mean.items()]
    outer_table = spark.createDataFrame(confirmed, "outer int, stage string, candidate int, setting string, n_test long, rmse double, mae double, r2 double")
    metrics = ("rmse", "mae", "r2")
    return {
        "search": spark.createDataFrame(search, "outer int, stage string, candidate int, setting string, rmse_mean double, rmse_std double, mae_mean double, r2_mean double, n_folds int, chosen boolean"),
        "outer": outer_table,
        "summary": outer_table.groupBy("stage").agg(*(f for m in metrics for f in (F.avg(m).alias(f"outer_{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"outer_{m}_std"))), F.count("*").alias("n_outer")),
        "final": spark.createDataFrame([r[1:-1] for r in search if r[0] is None and r[-1]], "stage string, candidate int, setting string, rmse_mean double, rmse_std double, mae_mean double, r2_mean double, n_folds int"),
    }


def _text(setting: dict) -> str:
    return json.dumps(setting, sort_keys=True)
