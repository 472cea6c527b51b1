"""Experiments on a panel of one's own, resumed runs, and the streamed components."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from terrapanel.operators.components import components
from terrapanel.plans import experiments, panels
from terrapanel.streaming import components as streamed

DESIGN = experiments.Design(controls=("t2m",), more_controls=(("ssrd",), ("t2m", "tp")), factor=2, factors=(1, 2), thresholds=(20, 60), reps=99, least_years=2, bandwidths_km=(10.0,), bins_km=(0, 6, 11), sample=None, cell_rows=20, cell_blocks=2)


@pytest.fixture(scope="module")
def panel(spark, sf01, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panel") / "p")
    panels.supplier_panel(spark, sf01).select("x", "y", "year", "month", "sif", "o3", "t2m", "ssrd", "tp", "lccs").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(experiments.EXPERIMENTS))
def test_experiment(panel, name):
    tables = experiments.EXPERIMENTS[name](experiments.prepare(panel, DESIGN), DESIGN)
    assert tables and all(len(t.take(1)) == 1 or (name, k) == ("trends", "trends") for k, t in tables.items() if not k.startswith("summary"))


def test_run_is_resumed(spark, panel, tmp_path, monkeypatch):
    """A second run computes nothing; another panel under the same settings is computed anew."""
    first = experiments.run(panel, DESIGN, str(tmp_path), ["primary"])["primary"]
    monkeypatch.setitem(experiments.EXPERIMENTS, "primary", lambda *a: pytest.fail("computed again"))
    again = experiments.run(panel, DESIGN, str(tmp_path), ["primary"])["primary"]
    assert set(again) == set(first) and again["pooled"].first() == first["pooled"].first()
    monkeypatch.undo()
    fewer = experiments.run(panel.where("x > 0"), DESIGN, str(tmp_path), ["primary"])["primary"]["pooled"].first()
    assert fewer.n < first["pooled"].first().n
    changed = str(tmp_path / "changed")
    panel.where("x > 0").write.parquet(changed)
    assert experiments.fingerprint(spark.read.parquet(changed)) != experiments.fingerprint(panel)
    assert experiments.run(spark.read.parquet(changed), DESIGN, str(tmp_path), ["primary"])["primary"]["pooled"].first().n == fewer.n


def test_broken_refits_go_on(spark, panel, tmp_path, monkeypatch):
    """A run that dies in its third fold keeps the first two; what it makes in the end is what an unbroken run makes."""
    from terrapanel.operators import boosted

    design = replace(DESIGN, folds=3, learner="gbt", learner_params=(("trees", 2), ("depth", 2)))
    own, grow, seen = panel.where("year < 1996"), boosted.Grower.grow, []

    def dying(self, codes, entries):
        seen.append(entries)
        if len(seen) == 3:
            raise RuntimeError("lost")
        return grow(self, codes, entries)

    monkeypatch.setattr(boosted.Grower, "grow", dying)
    with pytest.raises(RuntimeError, match="lost"):
        experiments.run(own, design, str(tmp_path / "a"), ["primary"])
    got = experiments.run(own, design, str(tmp_path / "a"), ["primary"])["primary"]["pooled"].first()
    assert seen == [[0, 1], [2, 3], [4, 5], [4, 5]]
    want = experiments.run(own, design, str(tmp_path / "b"), ["primary"])["primary"]["pooled"].first()
    assert abs(got.theta - want.theta) < 1e-12 and got.n == want.n


def test_generations_are_switched_whole(spark, tmp_path):
    from terrapanel.sources.sinks import checkpointed, manifest

    path, df = str(tmp_path / "t"), spark.range(3)
    first = checkpointed(df, path, {"a": 1})
    with pytest.raises(ZeroDivisionError):
        checkpointed(lambda: 1 // 0, path, {"a": 2}, spark)
    assert checkpointed(lambda: pytest.fail("made again"), path, {"a": 1}, spark).count() == 3
    second = checkpointed(spark.range(5), path, {"a": 2})
    assert (first.count(), second.count()) == (3, 5)  # readers of the first are not disturbed
    checkpointed(spark.range(7), path, {"a": 3})
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("rows-")]) == 2 and manifest(spark, path)["a"] == 3


def test_fingerprint_without_files(spark):
    a, b = spark.range(5), spark.range(6)
    assert experiments.fingerprint(a) == experiments.fingerprint(spark.range(5)) != experiments.fingerprint(b)


def test_cells_without_support_are_left_out(panel):
    rows = experiments.prepare(panel, DESIGN)
    kept, cells = experiments.gated(rows, replace(DESIGN, cell_rows=95), ["year", "month"])
    reasons = {r.reason for r in cells.select("reason").distinct().collect()}
    assert reasons >= {None, "rows"} and kept.count() == cells.where("eligible").agg(F.sum("n_rows")).first()[0] < rows.count()


def test_streamed_components(spark, panel, tmp_path):
    rows = experiments.residuals(experiments.prepare(panel, DESIGN), DESIGN, ["year"]).select("d", "r", "year", "month", "block")
    for year in (1995, 1996):
        rows.where(F.col("year") == year).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        streamed.accumulate(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {(r.year, r.month, r.block): r.n for r in streamed.accumulated(spark, str(tmp_path / "out")).collect()}
    want = {(r.year, r.month, r.block): r.n for r in components(rows.where("year in (1995, 1996)"), streamed.KEYS).collect()}
    assert got == want and want


def test_boosted_strata_are_models_of_their_own(spark):
    """Relations that change sign between years: with 2000 a year alone, rows of another year must not matter."""
    rows = [(float(i % 7) * (1 if y == 2000 else -1) + (i % 3), float(i % 7), float(i % 7), y, i % 2, 0) for y in (2000, 2001, 2002, 2003) for i in range(84)]
    df = spark.createDataFrame(rows, "sif double, o3 double, t2m double, year int, fold int, tfold int")
    design = experiments.Design(controls=("t2m",), folds=2, learner="gbt", learner_params=(("trees", 2), ("depth", 1)))
    fitted = lambda x: sorted((r.sif, r.t2m, r.fold, round(r.d, 9), round(r.r, 9)) for r in experiments.residuals(x, design, ["year"]).where("year = 2000").collect())
    got = fitted(df)
    assert len(got) == 84 and got == fitted(df.where("year = 2000"))


def test_placebo_takes_the_learner(panel, monkeypatch):
    design = replace(DESIGN, folds=2, learner="gbt", learner_params=(("trees", 1), ("depth", 1)))
    rows, seen = experiments.prepare(panel.where("year < 1998"), design), []
    fit = experiments.crossfit.gbt_residuals
    monkeypatch.setattr(experiments.crossfit, "gbt_residuals", lambda *a, **k: seen.append(1) or fit(*a, **k))
    assert experiments.placebo(rows, design)["joint"].count() and seen


def test_nested_search_keeps_the_outer_fold_out(spark):
    from terrapanel.operators import tuning

    rows = [(2.0 * (i % 11) + (i * 7 % 5), 3.0 * (i % 11) + (i * 3 % 4), float(i % 11), float(i // 3 % 2), i % 4, i // 7 % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "sif double, o3 double, t2m double, ssrd double, fold int, tfold int")
    stages, search = {"exposure": "o3", "outcome": "sif"}, lambda x, s: tuning.nested_search(x, stages, ["t2m", "ssrd"], s, 4, 3)
    ridge = lambda seed: [{"penalty": 0.0}, {"penalty": 100.0}]
    got = search(df, ridge)
    assert {(r.outer, r.stage, r.candidate): r.n_folds for r in got["search"].collect()} == {(o, s, c): 3 for o in (0, 1, 2, 3, None) for s in stages for c in (0, 1)}
    assert [r.setting for r in got["final"].collect()] == ['{"penalty": 0.0}'] * 2 and got["summary"].count() == 2
    held = df.where("fold = 0 or tfold = 0").count()
    assert {(r.outer, r.stage) for r in got["outer"].collect()} == {(o, s) for o in range(4) for s in stages} and held in {r.n_test for r in got["outer"].collect()}
    # other targets in the outer test rows change that fold's outer score, never its inner ones
    spoilt = search(df.withColumn("sif", F.when(F.expr("fold = 0 or tfold = 0"), F.col("sif") + 1000 * F.col("ssrd")).otherwise(F.col("sif"))), ridge)
    inner = lambda t: sorted((r.stage, r.candidate, round(r.rmse_mean, 9)) for r in t["search"].where("outer = 0").collect())
    assert inner(got) == inner(spoilt)
    at = lambda t: t["outer"].where("outer = 0 and stage = 'outcome'").first().rmse
    assert at(spoilt) > 2 * at(got)
    trees = search(df.where("fold < 3 and tfold < 3"), lambda seed: [{**c, "trees": 1, "depth": 2} for c in tuning.candidates(1, seed)])
    assert trees["final"].count() == 2 and "column_share" in trees["final"].first().setting


def test_specification_deltas_need_equal_rows(spark):
    from terrapanel.operators import diagnostics

    rows = [("a", 2, 1.0, 2.0, 4.0, [(2000, 2)]), ("b", 2, 1.5, 1.0, 1.0, [(2000, 2)]), ("c", 2, 3.0, 1.0, 1.0, [(2000, 1), (2001, 1)])]
    t = spark.createDataFrame(rows, "design string, n long, theta double, residual_sd double, den_per_row double, rows_by_year array<struct<year:int,m:long>>")
    got = {r.contrast: (r.same_rows, r.delta) for r in diagnostics.specification_deltas(t, {"x": ("a", "b"), "y": ("a", "c")}).collect()}
    assert got == {"x": (True, 0.5), "y": (False, None)}
    assert {r.design: (r.sd_to_a, r.information_to_a) for r in diagnostics.variation_ratios(t, ["a"]).collect()} == {"a": (1, 1), "b": (0.5, 0.25), "c": (0.5, 0.25)}
