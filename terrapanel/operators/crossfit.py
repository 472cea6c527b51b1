"""Out-of-fold residuals of exposure and outcome.

Least squares needs no second look at the rows: cross products are summed by stratum and fold, training sums of
a test cell are sums of the other cells, and the small systems are solved row by row.  The rows then meet their
coefficients by an equi-join on (stratum, test cell).  With many covariates the products of a task are summed with
NumPy before the shuffle.  Boosted trees of all strata, targets and test cells grow together (``boosted``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch
from . import boosted
from .folds import Split

WIDE = 10
KeepPart = Callable[[Callable[[], DataFrame], str], DataFrame]


def _columns(controls: list[str], targets: list[str]) -> list[str]:
    return [*controls, *targets]


def cross_products(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, products: the sums of 1 and the columns' products (upper triangle, row by row) of each group."""
    m = len(columns) + 1
    if m <= WIDE:
        values = [F.lit(1.0), *(F.col(c) for c in columns)]
        sums = [F.sum(values[i] * values[j]).alias(f"_p{i}_{j}") for i in range(m) for j in range(i, m)]
        wide = df.groupBy(*keys).agg(*sums)
        return wide.select(*keys, F.array(*(F.col(f"_p{i}_{j}") for i in range(m) for j in range(i, m))).alias("products"))
    upper = np.triu_indices(m)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, rows in batch.groupby(keys, sort=False):
                x = np.column_stack([np.ones(len(rows)), rows[columns].to_numpy(float)])
                held[key] = held.get(key, 0) + (x.T @ x)[upper]
        if held:
            yield pd.DataFrame([(*k, v) for k, v in held.items()], columns=[*keys, "products"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "products array<double>"])
    return add_up(df.select(*keys, *columns).mapInPandas(partial, schema), keys)


def add_up(df: DataFrame, keys: list[str]) -> DataFrame:
    """Element sums of ``products`` by keys."""
    each = df.select(*keys, F.posexplode("products").alias("at", "v")).groupBy(*keys, "at").agg(F.sum("v").alias("v"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("products"))


def solve(products: np.ndarray, n_controls: int, n_targets: int, ridge: float = 0.0) -> np.ndarray | None:
    """Intercept and slopes for each target (a row each); None if the system is singular."""
    m = 1 + n_controls + n_targets
    g = np.zeros((m, m))
    g[np.triu_indices(m)] = products
    g = g + np.triu(g, 1).T
    n, s = g[0, 0], g[0, 1:]
    if n < n_controls + 1:
        return None
    centred = g[1:, 1:] - np.outer(s, s) / n
    a, b = centred[:n_controls, :n_controls] + ridge * n * np.eye(n_controls), centred[:n_controls, n_controls:]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    try:
        slope = np.linalg.solve(a / np.outer(scale, scale), b / scale[:, None]) / scale[:, None] if n_controls else np.zeros((0, n_targets))
    except np.linalg.LinAlgError:
        return None
    if not np.isfinite(slope).all():
        return None
    return np.vstack([(s[n_controls:] - s[:n_controls] @ slope) / n, slope]).T


def coefficients(df: DataFrame, targets: list[str], controls: list[str], split: Split, strata: list[str], ridge: float = 0.0) -> DataFrame:
    """strata, test cell, beta (a list for each target) and n_train."""
    cells = cross_products(df, [*strata, *split.cells], _columns(controls, targets))
    keys = [*strata, *split.tests]
    size = (len(controls) + len(targets) + 1) * (len(controls) + len(targets) + 2) // 2
    train = split.train_rows(cells)
    if len(controls) + len(targets) + 1 <= WIDE:
        train = train.groupBy(*keys).agg(*(F.sum(F.col("products")[i]).alias(f"_s{i}") for i in range(size))).select(*keys, F.array(*(F.col(f"_s{i}") for i in range(size))).alias("products"))
    else:
        train = add_up(train.select(*keys, "products"), keys)
    kinds = dict(train.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [solve(np.asarray(p, float), len(controls), len(targets), ridge) for p in batch["products"]]
            yield batch[keys].assign(n_train=[float(p[0]) for p in batch["products"]], beta=[None if b is None else b.tolist() for b in found])

    return train.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n_train double", "beta array<array<double>>"]))


def predicted(df: DataFrame, beta: DataFrame, targets: list[str], controls: list[str], split: Split, strata: list[str]) -> DataFrame:
    """Test rows with ``target``_hat; rows whose model could not be fitted are left out."""
    rows = split.test_rows(df).join(beta, [*strata, *split.tests])
    hats = {}
    for i, t in enumerate(targets):
        b = F.col("beta")[i]
        hat = b[0]
        for j, c in enumerate(controls):
            hat = hat + b[j + 1] * F.col(c)
        hats[f"{t}_hat"] = hat
    return rows.where("beta is not null").withColumns(hats).drop("beta", "n_train")


def oof_residuals(df: DataFrame, exposure: str, outcome: str, controls: list[str], split: Split | None = None, strata: list[str] | None = None, more: dict[str, str] | None = None, ridge: float = 0.0) -> DataFrame:
    """Test rows with hats and residuals ``d`` (exposure), ``r`` (outcome) and those named in ``more`` (residual: column).

    Incomplete rows are left out.  A design of more than WIDE columns must be complete already: a filter on that many
    derived columns makes the optimizer try all combinations of their names.
    """
    split, strata = split or Split(), strata or []
    residual = {"d": exposure, "r": outcome} | (more or {})
    targets = list(residual.values())
    used = df.dropna(subset=list({*targets, *controls})) if len(controls) + len(targets) < WIDE else df
    beta = coefficients(used, targets, controls, split, strata, ridge)
    return predicted(used, beta, targets, controls, split, strata).withColumns({k: F.col(c) - F.col(f"{c}_hat") for k, c in residual.items()})


def gbt_residuals(df: DataFrame, exposure: str, outcome: str, controls: list[str], split: Split | None = None, seed: int = 42, strata: list[str] | None = None, more: dict[str, str] | None = None, keep: KeepPart | None = None, **params) -> DataFrame:
    """As oof_residuals, with gradient-boosted trees: a model a stratum, target and test cell, all grown together.

    ``keep`` is given a function that makes the rows of a part, and the part's name: a fold's models of some strata then are a
    part of their own, and one that is kept is not fitted again.  ``params`` replace those of ``boosted.SETTING``.  Every complete row must lie in a test cell of ``split``; cells without
    training rows are left out.  Rows are written once to the shared folder.
    """
    split, strata, spark = split or Split(), strata or [], df.sparkSession
    residual = {"d": exposure, "r": outcome} | (more or {})
    targets, times = list(dict.fromkeys(residual.values())), 1 if split.kind == "spatial" else split.k_time if split.kind == "both" else split.k
    used = df.dropna(subset=list({*targets, *controls, *strata}))
    at = scratch(spark, "boosted-rows")
    used.write.parquet(at)
    rows, n_strata = boosted.coded(spark.read.schema(used.schema).parquet(at), strata)
    if not n_strata:
        raise ValueError("no test cell has both training and test rows")
    rows = rows.withColumn("_cell", F.col("fold") * times + (F.lit(0) if split.kind == "spatial" else F.col("tfold")))
    folds = [tuple(r) for r in rows.select(*split.cells).distinct().collect()]  # k or k x k cells
    for fold in folds:
        if any(f is None or not 0 <= f < k for f, k in zip(fold, (split.k, times), strict=False)):
            raise ValueError(f"rows in {dict(zip(split.cells, fold, strict=True))} are in no test cell of {split}")
    tests = [(s, t) for s in range(split.k) for t in range(times if split.kind == "both" else 1)]
    trains = lambda f, s, t: f[0] != s and (split.kind == "spatial" or f[1] != (t if split.kind == "both" else s))
    held = lambda f, s, t: f == (s, t) if split.kind == "both" else s in f
    if not any(any(trains(f, s, t) for f in folds) and any(held(f, s, t) for f in folds) for s, t in tests):
        raise ValueError("no test cell has both training and test rows")
    masks = [np.array([trains((f, u), s, t) for f in range(split.k) for u in range(times)]) for s, t in tests]
    plan = [boosted.Model(i, mask, params) for mask in masks for i in range(len(targets))]
    shown = split.test_rows(rows).withColumn("_at", F.col("test") * (times if split.kind == "both" else 1) + (F.col("test_time") if split.kind == "both" else F.lit(0)))
    grower, out = boosted.Grower(rows, controls, targets, plan, seed), None

    def part(codes: range, entries: list[int]) -> DataFrame:
        group, first = grower.grow(codes, entries), entries[0] // len(targets)
        own = shown.where(F.col("_code").between(codes.start, codes.stop - 1) & F.col("_at").between(first, entries[-1] // len(targets)))
        own = own.withColumns({"_code": F.col("_code") - codes.start, "_at": (F.col("_at") - first).cast("int")})
        place = np.arange(len(entries) // len(targets)) * len(targets)
        return group.predict(own, {f"{t}_hat": place + i for i, t in enumerate(targets)}, "_at").drop("_code", "_cell", "_at")

    for codes, entries in boosted.groups(n_strata, plan, len(controls), len(targets), keep is not None):
        make = lambda codes=codes, entries=entries: part(codes, entries)
        one = make() if keep is None else keep(make, f"strata_{codes.start}_{codes.stop}_fold_{entries[0] // len(targets)}")
        out = one if out is None else out.unionByName(one)
    out = out.where(~F.isnan(f"{targets[0]}_hat"))
    return out.withColumns({k: F.col(c) - F.col(f"{c}_hat") for k, c in residual.items()})
