"""Fit quality, residual support and calibration over time folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles

QUANTILES = (0.01, 0.05, 0.5, 0.95, 0.99)
TIE = 1e-12  # residuals that differ by a smaller share are equal


def _r2(y: Column, p: Column) -> Column:
    n, spread = F.count(y), F.var_pop(y) * F.count(y)
    return F.when((n > 1) & (spread > 0), 1 - F.sum((y - p) * (y - p)) / spread)


def fit_metrics(rows: DataFrame, target: str, predicted: str, keys: list[str]) -> DataFrame:
    """keys, n, r2 (NULL for one row or a constant target), rmse, mae, bias (mean residual) and means."""
    y, p = F.col(target), F.col(predicted)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), _r2(y, p).alias("r2"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"),
        F.avg(y - p).alias("bias"), F.avg(y).alias("target_mean"), F.avg(p).alias("prediction_mean"),
    )


def staged_metrics(rows: DataFrame, stages: dict[str, str], keys: list[str]) -> DataFrame:
    """fit_metrics of several targets (stage: column, predicted in column_hat) in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(c).alias("y"), F.col(f"{c}_hat").alias("p")) for s, c in stages.items()))).alias("x")
    return fit_metrics(rows.select(*keys, each).select(*keys, "x.*"), "y", "p", [*keys, "stage"])


def residual_support(rows: DataFrame, keys: list[str], d: str = "d") -> DataFrame:
    """Spread of the exposure residual and the share of its information in its largest 5 and 1 per cent; exact quantiles.

    ``rows`` are read several times: keep them before.  Squares are added in whole units first, which is exact, and the rest after, so
    that the order of millions of rows does not show; residuals equal to a cut but for rounding count with it.
    """
    shown = quantiles(rows, keys, d, {f"q{int(q * 100):02d}": q for q in QUANTILES})
    cuts = quantiles(rows.withColumn("_a", F.abs(d)), keys, "_a", {"_cut5": 0.95, "_cut1": 0.99, "_most": 1.0})
    met = rows.join(cuts, keys) if keys else rows.crossJoin(F.broadcast(cuts))  # one row of cuts
    a, d2, edge = F.abs(d), F.col(d) * F.col(d), 1 - TIE
    unit = F.coalesce(F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_most") * F.col("_most"))) - 22), F.lit(1.0))
    whole = F.rint(d2 / unit) * unit
    out = met.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(d).alias("residual_mean"), F.stddev_samp(d).alias("residual_sd"), (F.sum(whole) + F.sum(d2 - whole)).alias("den"),
        F.sum(F.when(a >= F.col("_cut5") * edge, d2)).alias("top5"), F.sum(F.when(a >= F.col("_cut1") * edge, d2)).alias("top1"),
    )
    out = out.join(shown, keys) if keys else out.crossJoin(shown)  # a row each
    return out.select(*keys, "n", "residual_mean", "residual_sd", *(c for c in shown.columns if c not in keys), "den", (F.col("den") / F.col("n")).alias("den_per_row"), (F.col("top5") / F.col("den")).alias("top5_share"), (F.col("top1") / F.col("den")).alias("top1_share"))


def calibration(rows: DataFrame, exposure: str, outcome: str, fold: str = "tfold") -> DataFrame:
    """A row a time fold: fit of both stages, residual moments, information and score shares, local effect."""
    t = rows.agg(F.sum(F.col("d") * F.col("r")).alias("num"), F.sum(F.col("d") * F.col("d")).alias("den"))
    rows = rows.crossJoin(F.broadcast(t))  # one row
    theta = F.col("num") / F.col("den")
    score = F.col("d") * (F.col("r") - theta * F.col("d"))
    e, o = F.col(exposure), F.col(outcome)
    eh, oh = e - F.col("d"), o - F.col("r")
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    per = rows.groupBy(fold).agg(
        F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.count("*").alias("n"),
        _r2(e, eh).alias("exposure_r2"), rms("d").alias("exposure_rmse"), F.avg(F.abs("d")).alias("exposure_mae"), F.avg("d").alias("exposure_residual_mean"), F.stddev_samp("d").alias("exposure_residual_sd"),
        _r2(o, oh).alias("outcome_r2"), rms("r").alias("outcome_rmse"), F.avg(F.abs("r")).alias("outcome_mae"), F.avg("r").alias("outcome_residual_mean"), F.stddev_samp("r").alias("outcome_residual_sd"),
        F.sum(F.col("d") * F.col("r")).alias("fold_num"), F.sum(F.col("d") * F.col("d")).alias("fold_den"), F.sum(score).alias("score_sum"), F.sum(F.abs(score)).alias("score_abs"),
    )
    whole = per.agg(F.sum("fold_den").alias("all_den"), F.sum("score_abs").alias("all_abs"))
    per = per.crossJoin(F.broadcast(whole))  # one row
    return per.select(
        (F.col(fold) + 1).alias("time_fold"), "year_min", "year_max", "n", *(f"{s}_{m}" for s in ("exposure", "outcome") for m in ("r2", "rmse", "mae", "residual_mean", "residual_sd")),
        *(F.try_divide(F.abs(f"{s}_residual_mean"), f"{s}_residual_sd").alias(f"{s}_bias_over_sd") for s in ("exposure", "outcome")),
        F.col("fold_num").alias("num"), F.col("fold_den").alias("den"), (F.col("fold_den") / F.col("n")).alias("den_per_row"), F.try_divide("fold_den", "all_den").alias("information_share"),
        (F.try_divide("fold_num", "fold_den") * 10).alias("local_effect"), "score_sum", F.try_divide("score_abs", "all_abs").alias("score_share"),
    )


def calibration_summary(cal: DataFrame) -> DataFrame:
    """One row: share of the last two folds, largest biases, least fits, range of local effects."""
    last = cal.agg(F.max("time_fold").alias("last"))
    c = cal.crossJoin(F.broadcast(last))  # one row
    return c.agg(
        F.count("*").alias("n_folds"), F.sum(F.when(F.col("time_fold") > F.col("last") - 2, F.col("information_share"))).alias("late_share"),
        F.max(F.abs("exposure_residual_mean")).alias("max_exposure_bias"), F.max("exposure_bias_over_sd").alias("max_exposure_bias_over_sd"),
        F.max(F.abs("outcome_residual_mean")).alias("max_outcome_bias"), F.max("outcome_bias_over_sd").alias("max_outcome_bias_over_sd"),
        F.min("exposure_r2").alias("min_exposure_r2"), F.min("outcome_r2").alias("min_outcome_r2"), F.min("local_effect").alias("effect_min"), F.max("local_effect").alias("effect_max"),
    )


def combined_moments(yearly: DataFrame, keys: list[str], n: str, mean: str, sd: str) -> DataFrame:
    """keys, n, mean and sd of the rows behind per-year counts, means and deviations."""
    nn, m, s = F.col(n), F.col(mean), F.coalesce(F.col(sd), F.lit(0.0))
    out = yearly.groupBy(*keys).agg(F.sum(nn).alias("n"), F.sum(nn * m).alias("_s"), F.sum((nn - 1) * s * s + nn * m * m).alias("_ss"))
    mu = F.col("_s") / F.col("n")
    return out.select(*keys, "n", mu.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), (F.col("_ss") - F.col("n") * mu * mu) / F.greatest(F.lit(1), F.col("n") - 1))).alias("sd"))


def weighted_fit(metrics: DataFrame, keys: list[str], n: str = "n", r2: str = "r2") -> DataFrame:
    """keys, n and r2 weighted by rows, of the fits of several cells (cells without an r2 carry no weight)."""
    w = F.when(F.col(r2).isNotNull(), F.col(n))
    return metrics.groupBy(*keys).agg(F.sum(n).alias("n"), F.try_divide(F.sum(w * F.col(r2)), F.sum(w)).alias("r2_weighted"))


def support_table(cells: DataFrame, keys: list[str], value: str, over: str) -> DataFrame:
    """keys, number of cells (different ``over``), and sum, mean, least, median and largest of ``value``."""
    return cells.groupBy(*keys).agg(F.count_distinct(over).alias(f"n_{over}"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("most"))


def sanity(metrics: DataFrame, keys: list[str], value: str = "r2") -> DataFrame:
    """keys, number of fits, mean, median, least and largest fit, and how many are negative."""
    return metrics.groupBy(*keys).agg(F.count(value).alias("n_fits"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.count_if(F.col(value) < 0).alias("n_negative"))


def threshold_support(metrics: DataFrame, keys: list[str], n: str, value: str, thresholds: list[int]) -> DataFrame:
    """keys, stage, threshold: cells with at least so many rows, their rows, and the 5 % point, median and least of their fit."""
    each = metrics.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where(F.col(n) >= F.col("threshold"))
    return each.groupBy(*keys, "stage", "threshold").agg(F.count("*").alias("n_cells"), F.sum(n).alias("n_rows"), F.percentile(value, F.lit(0.05)).alias("q05"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("least"))


def collinearity(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of two residuals, variance inflation and the condition number of their correlation matrix."""
    r = rows.agg(F.corr(a, b).alias("r"), F.count("*").alias("n"))
    c = F.col("r")
    return r.select("n", c.alias("correlation"), (1 / F.greatest(F.lit(1e-12), 1 - c * c)).alias("vif"), F.try_divide(1 + F.abs(c), 1 - F.abs(c)).alias("condition"))


def summary(df: DataFrame, keys: list[str], values: list[str], distinct: list[str] | None = None) -> DataFrame:
    """Row counts, ranges, means, deviations, medians and distinct counts by keys."""
    aggs = [F.count("*").alias("n")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    out = df.groupBy(*keys).agg(*aggs, *(F.count_distinct(c).alias(f"{c}_distinct") for c in distinct or []))
    for v in values:
        out = out.join(quantiles(df, keys, v, {f"{v}_median": 0.5}), keys, "left")
    return out


def heat_table(cells: DataFrame, row: str, rows: list | None, value: str, column: str = "year") -> DataFrame:
    """A row for each of ``rows`` (by default those that occur), a column y<year> for each year, and ``reach``, the largest
    absolute value of the whole table, for a scale around 0; cells that are not there are NULL.  ``cells`` has a row a cell."""
    kind = dict(cells.dtypes)[row]
    years = [r[0] for r in cells.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    wide = cells.groupBy(row).agg(F.lit(0).alias("_"), *(F.max(F.when(F.col(column) == y, F.col(value))).alias(f"y{y}") for y in years)).drop("_")
    if rows is not None:
        wide = cells.sparkSession.createDataFrame([(r,) for r in rows], f"{row} {kind}").join(wide, row, "left")
    return wide.crossJoin(F.broadcast(cells.agg(F.max(F.abs(value)).alias("reach"))))  # a row


def specification(rows: DataFrame, effect: DataFrame, design: str) -> DataFrame:
    """One row: a pooled effect with its row counts (all, and by year) and the variation that identifies it."""
    years = rows.groupBy("year").agg(F.count("*").alias("m")).agg(F.array_sort(F.collect_list(F.struct("year", "m"))).alias("rows_by_year"))
    spread = rows.agg(F.stddev_samp("d").alias("residual_sd"), (F.sum(F.col("d") * F.col("d")) / F.count("*")).alias("den_per_row"))
    return effect.select(F.lit(design).alias("design"), "n", "theta", "se", "p_t").crossJoin(F.broadcast(years)).crossJoin(F.broadcast(spread))  # a row each


def specification_deltas(table: DataFrame, contrasts: dict[str, tuple[str, str]]) -> DataFrame:
    """contrast, a, b, same_rows and theta of b minus theta of a; NULL unless rows agree in all and by year."""
    names = table.sparkSession.createDataFrame([(c, a, b) for c, (a, b) in contrasts.items()], "contrast string, a string, b string")
    side = lambda x: table.select(F.col("design").alias(x), F.col("theta").alias(f"theta_{x}"), F.col("n").alias(f"n_{x}"), F.col("rows_by_year").alias(f"years_{x}"))
    met = names.join(side("a"), "a").join(side("b"), "b").withColumn("same_rows", (F.col("n_a") == F.col("n_b")) & (F.col("years_a") == F.col("years_b")))
    return met.select("contrast", "a", "b", "same_rows", F.when(F.col("same_rows"), F.col("theta_b") - F.col("theta_a")).alias("delta"))


def variation_ratios(table: DataFrame, against: list[str]) -> DataFrame:
    """The table's rows with the ratios of residual_sd and den_per_row to those of the named designs."""
    for name in against:
        base = table.where(F.col("design") == name).select(F.col("residual_sd").alias("_sd"), F.col("den_per_row").alias("_info"))
        table = table.crossJoin(F.broadcast(base)).withColumns({f"sd_to_{name}": F.col("residual_sd") / F.col("_sd"), f"information_to_{name}": F.col("den_per_row") / F.col("_info")}).drop("_sd", "_info")
    return table
