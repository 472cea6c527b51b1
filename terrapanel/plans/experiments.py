"""The analyses a panel is usually put through, on a panel of one's own.

``prepare`` adds ids and folds to a panel; each experiment takes the prepared rows, a ``Design`` and ``keep``, and returns
named result tables.  ``keep`` writes what several tables need (residuals, components), so that no model is fitted twice.
``run`` writes tables below a folder.  An experiment that is there whole under the same settings and the same panel is
read back and not computed; of a broken one the parts that are whole are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid, block_id, cell_index, grid_of, pixel_id
from ..operators import bootstrap, climate, correlogram, crossfit, diagnostics, features, inference, kernel, trend, tuning
from ..operators.components import components
from ..operators.folds import Split, assigned, balanced_folds, chunk_folds, dense_folds, shuffled_folds
from ..operators.multiplicity import fdr
from ..sources.sinks import checkpointed, read_checkpoint, read_metadata, write_metadata

Tables = dict[str, DataFrame]
Keep = Callable[[DataFrame | Callable[[], DataFrame], str], DataFrame]
PENALTIES = [0.0, 0.01, 0.1, 1.0]
POLICIES = {"balanced": balanced_folds, "shuffled": shuffled_folds, "sorted": lambda df, key, k, seed: dense_folds(df, key, k)}


@dataclass(frozen=True)
class Design:
    outcome: str = "sif"
    exposure: str = "o3"
    controls: tuple[str, ...] = ("t2m", "ssrd", "tp")
    more_controls: tuple[tuple[str, ...], ...] = ()
    factor: int = 20
    factors: tuple[int, ...] = (10, 20, 30)
    folds: int = 5
    policy: str = "balanced"
    seed: int = 42
    learner: str = "ols"
    learner_params: tuple[tuple[str, float], ...] = ()
    candidates: int = 30
    inner_folds: int = 4
    class_column: str = "lccs"
    thresholds: tuple[int, ...] = (5_000, 10_000, 20_000)
    cell_rows: int = 20_000
    cell_blocks: int = 15
    least_months: int = 6
    least_years: int = 5
    reps: int = bootstrap.REPS
    bandwidths_km: tuple[float, ...] = (50.0, 75.0, 100.0)
    bins_km: tuple[float, ...] = correlogram.BINS_KM
    sample: int | None = 1500


def as_is(df: DataFrame, name: str) -> DataFrame:
    return df


def prepare(panel: DataFrame, design: Design, grid: Grid | None = None) -> DataFrame:
    """Rows with pixel, block, ix, iy, time features, fold and tfold; rows without outcome or exposure are left out."""
    grid = grid or grid_of(panel)
    ix, iy = cell_index(grid)
    rows = features.time_features(panel.dropna(subset=[design.outcome, design.exposure])).withColumns({"pixel": pixel_id(grid), "block": block_id(grid, design.factor), "ix": ix, "iy": iy})
    rows = assigned(rows, F.broadcast(POLICIES[design.policy](rows, "block", design.folds, design.seed)), "block")
    return assigned(rows, F.broadcast(chunk_folds(rows, "year", design.folds)), "year")


def residuals(rows: DataFrame, design: Design, strata: list[str] | None = None, split: Split | None = None, controls: tuple[str, ...] | None = None, suffix: str = "", more: dict[str, str] | None = None, keep: Keep | None = None, variant: str = "") -> DataFrame:
    """Out-of-fold residuals of the design's learner, a model a stratum; ``suffix`` picks transformed columns.

    Boosted trees are kept by parts under the name of the ``variant``: a broken run goes on with the first fold that lacks.
    """
    names = [f"{c}{suffix}" for c in (controls or design.controls)]
    exposure, outcome = f"{design.exposure}{suffix}", f"{design.outcome}{suffix}"
    split = split or Split("spatial", design.folds, design.folds)
    if design.learner == "gbt":
        return crossfit.gbt_residuals(rows, exposure, outcome, names, split, design.seed, strata, more, None if keep in (None, as_is) else lambda make, part: keep(make, f"fits/{variant}/{part}"), **dict(design.learner_params))
    return crossfit.oof_residuals(rows, exposure, outcome, names, split, strata, more)


def pooled(rows: DataFrame, small: bool = True) -> DataFrame:
    return inference.with_t(inference.two_way(components(rows, ["block", "year"]), [], "block", "year", small))


def full_period(rows: DataFrame, design: Design, keep: Keep = as_is) -> Tables:
    out = keep(residuals(rows, design, split=Split("both", design.folds, design.folds)), "residuals")
    cal = diagnostics.calibration(out, design.exposure, design.outcome)
    return {"effect": pooled(out, small=False), "calibration": cal, "calibration_summary": diagnostics.calibration_summary(cal)}


def primary(rows: DataFrame, design: Design, keep: Keep = as_is) -> Tables:
    """A model a year; annual effects (block x month), pooled effect (block x year), support and fit."""
    out = keep(residuals(rows, design, ["year"], keep=keep, variant="primary"), "residuals")
    comp = keep(components(out, ["block", "year", "month"]), "components")
    stages = {"exposure": design.exposure, "outcome": design.outcome}
    return {
        "annual": fdr(inference.with_t(inference.two_way(comp, ["year"], "block", "month")), "p_t"), "pooled": inference.with_t(inference.two_way(comp, [], "block", "year")),
        "support": diagnostics.residual_support(out, ["year"]), "fit": diagnostics.staged_metrics(out, stages, ["year"]), "components": comp,
    }


def strict_within(rows: DataFrame, design: Design, keep: Keep = as_is) -> Tables:
    columns = [design.outcome, design.exposure, *design.controls]
    return {"pooled": pooled(residuals(features.within_pixel_year(rows, columns, least=design.least_months), design, ["year"], suffix="_w"))}


def interannual(rows: DataFrame, design: Design, keep: Keep = as_is) -> Tables:
    """Anomalies within pixel and month against the raw design on the same rows and folds."""
    columns = [design.outcome, design.exposure, *design.controls]
    w = features.within_pixel_month(rows, columns, least=design.least_years)
    raw = residuals(w, design).withColumnsRenamed({"d": "d_raw", "r": "r_raw"}).drop("test")
    both = keep(residuals(raw, design, suffix="_w"), "residuals")
    return {"pooled": pooled(both), "contrast": inference.paired_contrast(both, ("d_raw", "r_raw"), ("d", "r"), "block", "year"), "audit": features.within_audit(w, ["pixel", "month"], columns[:2])}


def placebo(rows: DataFrame, design: Design, keep: Keep = as_is) -> Tables:
    """Current and next year's exposure together."""
    ahead = features.future_exposure(rows, design.exposure)
    out = keep(residuals(ahead, design, ["year"], more={"e": f"{design.exposure}_next"}), "residuals")
    return {"joint": inference.with_t(inference.joint_effects(out, ["d", "e"], "r", "block", "year")), "collinearity": diagnostics.collinearity(out, "d", "e")}


def block_scale(rows: DataFrame, design: Design, keep: Keep = as_is) -> Tables:
    grid, parts = grid_of(rows), None
    for factor in design.factors:
        own = prepare(rows.drop("pixel", "block", "ix", "iy", "fold", "tfold"), replace(design, factor=factor), grid)
        one = pooled(residuals(own, design, ["year"])).withColumn("factor", F.lit(factor))
        parts = one if parts is None else parts.unionByName(one)
    out = residuals(rows, design, ["year"]).withColumn("id", F.col("pixel"))
    by_cell = keep(correlogram.correlogram(out, ["d", "r"], design.bins_km, sample=design.sample), "pairs")
    return {"pooled": parts, "correlogram": correlogram.pooled_correlogram(by_cell, design.bins_km), "dependence": correlogram.dependence_summary(correlogram.pooled_correlogram(by_cell, design.bins_km), design.factor * grid.dx / 1000)}


def control_sets(rows: DataFrame, design: Design, keep: Keep = as_is) -> Tables:
    """Each set of covariates on the rows that are complete for all of them."""
    sets, parts = (design.controls, *design.more_controls), None
    common = rows.dropna(subset=sorted({c for s in sets for c in s}))
    for i, s in enumerate(sets):
        one = pooled(residuals(common, design, ["year"], controls=s)).withColumn("set", F.lit(i))
        parts = one if parts is None else parts.unionByName(one)
    return {"pooled": parts}


def resampling(rows: DataFrame, design: Design, keep: Keep = as_is) -> Tables:
    comp = keep(components(residuals(rows, design, ["year"]), ["block", "year", "month"]), "components")
    return {"month": fdr(bootstrap.wild_month(comp, ["year"], reps=design.reps), "p_wild"), "year": bootstrap.wild_year(comp, reps=design.reps)}


def time_trend(rows: DataFrame, design: Design, keep: Keep = as_is) -> Tables:
    return {"trend": inference.linear_trend(keep(components(residuals(rows, design, ["year"]), ["block", "year"]), "components"))}


def refits(rows: DataFrame, design: Design, keep: Keep = as_is) -> Tables:
    """Fold policies and splits side by side, without small-sample factors."""
    parts = None
    for name, policy, kind in (("spatial_shuffled", "shuffled", "spatial"), ("both_shuffled", "shuffled", "both"), ("spatial_balanced", "balanced", "spatial")):
        own = assigned(rows.drop("fold"), F.broadcast(POLICIES[policy](rows, "block", design.folds, design.seed)), "block")
        one = pooled(residuals(own, design, split=Split(kind, design.folds, design.folds), keep=keep, variant=name), small=False).withColumn("refit", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    return {"pooled": parts}


def _heterogeneity(comp: DataFrame, key: str) -> Tables:
    test, pairs = inference.heterogeneity(comp, key)
    spark = comp.sparkSession
    return {"omnibus": spark.createDataFrame([tuple(map(float, test.values()))], "f double, df1 double, df2 double, p double"), "pairs": spark.createDataFrame(pairs)}


def gated(rows: DataFrame, design: Design, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the cells with enough rows, blocks and folds for a model, and every cell with the reason it is left out for."""
    cells = features.eligibility(rows, keys, design.cell_rows, design.cell_blocks, design.folds)
    return rows.join(cells.where("eligible").select(*keys), keys, "left_semi"), cells


def by_month(rows: DataFrame, design: Design, keep: Keep = as_is) -> Tables:
    own, cells = gated(rows, design, ["year", "month"])
    comp = keep(components(residuals(own, design, ["year", "month"]), ["month", "year", "block"]), "components")
    return {
        "eligibility": cells, "cells": (each := inference.with_t(inference.one_way(comp, ["year", "month"], "block"), second=None)), "heat": diagnostics.heat_table(each, "month", list(range(1, 13)), "effect"), "pooled": inference.with_t(inference.two_way(comp, ["month"], "block", "year")),
        "signs": inference.annual_signs(comp, ["month"]), "wild": bootstrap.wild_year(comp, ["month"], reps=design.reps), **_heterogeneity(comp, "month"),
    }


def by_class(rows: DataFrame, design: Design, keep: Keep = as_is) -> Tables:
    own = rows.withColumn("class", features.class_group(F.col(design.class_column))).where("class is not null")
    own, cells = gated(own, design, ["class", "year"])
    out = keep(residuals(own, design, ["class", "year"]), "residuals")
    comp = keep(components(out, ["class", "year", "block", "month"]), "components")
    fit = diagnostics.staged_metrics(out, {"exposure": design.exposure, "outcome": design.outcome}, ["class", "year"])
    return {
        "eligibility": cells, "annual": (each := inference.with_t(inference.two_way(comp, ["class", "year"], "block", "month"))), "heat": diagnostics.heat_table(each, "class", None, "effect"), "pooled": inference.with_t(inference.two_way(comp, ["class"], "block", "year")),
        "signs": inference.annual_signs(comp, ["class"]), "thresholds": inference.with_t(inference.repooled(comp, "class", list(design.thresholds), ["class", "year"])),
        "threshold_support": diagnostics.threshold_support(fit, ["class"], "n", "r2", list(design.thresholds)), "sanity": diagnostics.sanity(fit, ["stage"], "r2"), **_heterogeneity(comp, "class"),
    }


def kernel_maps(rows: DataFrame, design: Design, keep: Keep = as_is) -> Tables:
    grid, out = grid_of(rows), {}
    comp = keep(components(residuals(rows, design, ["year"]), ["ix", "iy", "year", "month"]), "components")
    for bw in design.bandwidths_km:
        masked = keep(kernel.support_mask(kernel.effect_map(comp, grid, bw)), f"masked_{bw:g}km")
        out |= {f"map_{bw:g}km": kernel.with_intervals(masked), f"summary_{bw:g}km": kernel.map_summary(masked), f"peak_{bw:g}km": kernel.rank_months(masked)}
    return out


def climate_state(rows: DataFrame, design: Design, keep: Keep = as_is, value: str = "t2m") -> Tables:
    comp = keep(components(residuals(rows, design, ["year"]), ["pixel", "block", "year", "month"], **{value: F.avg(value)}), "components")
    held = climate.supported(comp, value, least_years=2 * design.least_years)
    fit, found = climate.fitted(held, value), climate.modifier(held, value, reps=design.reps)
    record = climate.decision(found, fit)
    shown = rows.sparkSession.createDataFrame(found).withColumn("direction", F.lit(record["direction"]))
    return {"decision": rows.sparkSession.createDataFrame([record]), "climatology": climate.climatology_support(comp, value), "moments": climate.weighted_moments(held, value), "modifier": shown, "curves": climate.response_curves(held, fit, value)}


def trends(rows: DataFrame, design: Design, keep: Keep = as_is) -> Tables:
    values = [design.outcome, design.exposure]
    yearly = trend.yearly_means(rows, values)
    least = trend.least_years(rows.select("year").distinct().count())
    out = trend.with_fdr(keep(trend.trends(yearly, values, least=least), "trends"))
    return {"trends": out, "summary": trend.fdr_summary(out), "places": trend.spatial_stats(rows, values, ["ix", "iy"])}


def tuned(rows: DataFrame, design: Design, keep: Keep = as_is) -> Tables:
    """Nested search of the learner's settings for exposure and outcome, and the one-level ridge grid of the outcome."""
    scores = tuning.ridge_search(rows, design.outcome, list(design.controls), PENALTIES, design.folds)
    settings = (lambda seed: tuning.candidates(design.candidates, seed)) if design.learner == "gbt" else (lambda seed: [{"penalty": p} for p in PENALTIES])
    nested = tuning.nested_search(rows, {"exposure": design.exposure, "outcome": design.outcome}, list(design.controls), settings, design.folds, design.inner_folds, design.seed)
    return {"scores": scores, "best": tuning.best(scores), **nested}


def specifications(rows: DataFrame, design: Design, keep: Keep = as_is) -> Tables:
    """Designs side by side on the same rows: deltas of their effects, and the variation that identifies each."""
    rows, both, parts = rows.dropna(subset=list(design.controls)), Split("both", design.folds, design.folds), []
    shuffled = assigned(rows.drop("fold"), F.broadcast(POLICIES["shuffled"](rows, "block", design.folds, design.seed)), "block")
    balanced = assigned(rows.drop("fold"), F.broadcast(POLICIES["balanced"](rows, "block", design.folds, design.seed)), "block")
    for name, own, strata, split, small in (
        ("spatial_shuffled", shuffled, None, None, False), ("both_shuffled", shuffled, None, both, False), ("spatial_balanced", balanced, None, None, False),
        ("full_period", rows, None, both, False), ("primary", rows, ["year"], None, True),
    ):
        out = residuals(own, design, strata, split, keep=keep, variant=name)
        parts.append(diagnostics.specification(out, pooled(out, small), name))
    columns = [design.outcome, design.exposure, *design.controls]
    within = features.within_pixel_month(rows, columns, least=design.least_years)
    for name, suffix in (("paired_raw", ""), ("paired_interannual", "_w")):
        out = residuals(within, design, suffix=suffix)
        parts.append(diagnostics.specification(out, pooled(out), name))
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    contrasts = {"temporal_holdout": ("spatial_shuffled", "both_shuffled"), "fold_policy": ("both_shuffled", "full_period"), "architecture": ("spatial_balanced", "primary")}
    return {"deltas": diagnostics.specification_deltas(table, contrasts), "variation": diagnostics.variation_ratios(table, ["primary", "paired_raw"])}


EXPERIMENTS: dict[str, Callable[[DataFrame, Design, Keep], Tables]] = {
    "full_period": full_period, "primary": primary, "strict_within": strict_within, "interannual": interannual, "placebo": placebo, "block_scale": block_scale, "control_sets": control_sets, "resampling": resampling,
    "time_trend": time_trend, "refits": refits, "by_month": by_month, "by_class": by_class, "kernel_maps": kernel_maps, "climate_state": climate_state, "trends": trends, "tuned": tuned,
    "specifications": specifications,
}


def fingerprint(panel: DataFrame) -> str:
    """What names the panel's rows, in whatever order and files they come: their number and sums over two hashes of each.

    One pass over the panel; a filtered or derived panel has a name of its own, a rewritten one keeps it.
    """
    one, two = F.xxhash64(*sorted(panel.columns)), F.xxhash64(F.lit(1), *sorted(panel.columns))
    found = panel.agg(F.count("*"), F.sum(one.cast("decimal(20,0)")), F.sum(two.cast("decimal(20,0)"))).first()
    return "/".join([*sorted(f"{c}:{t}" for c, t in panel.dtypes), *map(str, found)])


def run(panel: DataFrame, design: Design, out: str, names: list[str] | None = None) -> dict[str, Tables]:
    """Result tables of the named experiments (all by default), written below ``out``."""
    spark, done, rows = panel.sparkSession, {}, None
    base = asdict(design) | {"panel": fingerprint(panel)}
    for name in names or list(EXPERIMENTS):
        config, made = {"experiment": name} | base, f"{out}/{name}/_whole"
        held = read_metadata(spark, made, config)
        tables = {} if held is None else {t: read_checkpoint(spark, f"{out}/{name}/{t}", config | {"table": t}) for t in held["tables"]}
        if tables and all(t is not None for t in tables.values()):
            done[name] = tables
            continue
        rows = rows if rows is not None else prepare(panel, design)
        keep = lambda df, part: checkpointed(df, f"{out}/{name}/_work/{part}", config | {"part": part}, spark)  # noqa: E731, B023
        done[name] = {t: checkpointed(df, f"{out}/{name}/{t}", config | {"table": t}) for t, df in EXPERIMENTS[name](rows, design, keep).items()}
        write_metadata(spark, made, config, tables=list(done[name]))
    return done
