"""Boosted trees of many models against plain NumPy ones, and exact quantiles against NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import boosted, quantiles
from terrapanel.operators.tuning import RANGES, candidates


def plain_trees(x, y, train, cuts, unit, low, setting, tree_rows, tree_columns):
    """Predictions for all rows of one model, grown one node at a time."""
    s = boosted.SETTING | setting
    bins = np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    whole = np.floor((y - low) / unit + 0.5).astype(np.int64)
    hat = np.full(len(y), int(whole[train].sum()) // int(train.sum()), np.int64)
    l1, gamma = s["l1"] / unit, s["least_gain"] / unit**2
    score = lambda g, n: max(0.0, abs(float(g)) - l1) ** 2 / (n + s["l2"])
    for number in range(s["trees"]):
        g_all, step = hat - whole, np.zeros(len(y), np.int64)

        def split(rows, level):
            own = rows & train & tree_rows(number)
            g, n = int(g_all[own].sum()), int(own.sum())
            best = None
            if level < s["depth"] and n:
                for f in tree_columns(number):
                    for b in np.unique(bins[own, f]):
                        left = own & (bins[:, f] <= b)
                        gl, nl = int(g_all[left].sum()), int(left.sum())
                        if min(nl, n - nl) < max(1, s["least_rows"]):
                            continue
                        gain = score(gl, nl) + score(g - gl, n - nl) - score(g, n)
                        if gain > gamma and (best is None or gain > best[0]):
                            best = (gain, f, b)
            if best is None:
                step[rows] = math.floor(s["rate"] * -math.copysign(max(0.0, abs(float(g)) - l1), g) / (n + s["l2"]) + 0.5) if n else 0
            else:
                split(rows & (bins[:, best[1]] <= best[2]), level + 1)
                split(rows & (bins[:, best[1]] > best[2]), level + 1)

        split(np.ones(len(y), bool), 0)
        hat = hat + step
    return low + hat * unit


SETTINGS = [{"trees": 3, "depth": 3, "l1": 0.4, "l2": 2.0}, {"trees": 5, "depth": 1, "rate": 0.3, "least_rows": 9}, {"trees": 4, "depth": 2, "least_gain": 3.0, "column_share": 0.5, "row_share": 0.7}]


@pytest.mark.parametrize("renew", [2, 10])
def test_trees_like_numpy(spark, monkeypatch, renew):
    rng = np.random.default_rng(renew)
    n = 500
    d = pd.DataFrame({"a": rng.normal(size=n) * 10.0 ** rng.integers(-3, 4, n), "b": rng.integers(0, 5, n).astype(float), "c": np.ones(n), "g": rng.choice(["u", "v"], n), "fold": rng.integers(0, 3, n)})
    d["y"] = np.sign(d.a) * 2 + d.b * np.where(d.g == "u", 1, -1) + rng.normal(size=n) * 0.1
    d["z"] = d.a.clip(-1, 1) - d.y
    monkeypatch.setattr(boosted, "RENEW", renew)
    rows, k = boosted.coded(spark.createDataFrame(d).repartition(5).withColumn("_cell", F.col("fold")), ["g"])
    names, targets = ["a", "b", "c"], ["y", "z"]
    plan = [boosted.Model(i, np.array([f != t for f in range(3)]), s) for t in range(3) for s in SETTINGS for i in range(2)]
    cuts, units = boosted.edges_of(rows, names), boosted.units_of(rows, targets)
    assert [len(c) for c in cuts] == [63, 5, 1]
    kept = rows.persist()
    pdf = kept.select("*", F.xxhash64(*kept.columns).alias("key")).toPandas()
    for codes, entries, group in boosted.grown(kept, names, targets, plan, k, 7):
        got = group.predict(kept, {f"h{e}": np.full(3, i) for i, e in enumerate(entries)}, "_cell").toPandas().sort_values(["a", "b", "y"])
    own = pdf.sort_values(["a", "b", "y"])
    for e, m in enumerate(plan):
        for code in range(k):
            r = (own._code == code).to_numpy()
            x, y, key = own[names].to_numpy()[r], own[targets[m.target]].to_numpy()[r], own["key"].to_numpy()[r]
            chosen = lambda number: boosted.mixed(key, boosted.seed_of(7, "rows", e, number)) < m["row_share"]  # noqa: E731, B023
            columns = lambda number: boosted.columns_of(e, number, 3, m["column_share"], 7)  # noqa: E731, B023
            want = plain_trees(x, y, m.trains[own["fold"].to_numpy()[r]], cuts, units[m.target][1], units[m.target][0], m.setting, chosen, columns)
            assert (got[f"h{e}"].to_numpy()[r] == want).all()
    kept.unpersist()


def test_scores_and_small_groups_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    d = pd.DataFrame({"a": rng.normal(size=300), "fold": rng.integers(0, 2, 300), "s": rng.integers(0, 3, 300)}).assign(y=lambda t: t.a**2 + t.s)
    rows, k = boosted.coded(spark.createDataFrame(d).withColumn("_cell", F.col("fold")), ["s"])
    plan = [boosted.Model(0, np.array([f != t for f in range(2)]), {"trees": 6, "depth": 2}) for t in range(2)]
    hats = {}
    for bound in (boosted.MAX_NODES, 1):
        monkeypatch.setattr(boosted, "MAX_NODES", bound)
        made = list(boosted.grown(rows, ["a"], ["y"], plan, k))
        assert len(made) == (1 if bound > 1 else k * 2)
        parts = []
        for codes, entries, group in made:
            shown = rows.where(F.col("_code").between(codes.start, codes.stop - 1) & F.col("fold").isin(entries)).withColumn("_code", F.col("_code") - codes.start)
            parts.append(group.predict(shown, {"hat": np.arange(2) - entries[0]}, "_cell").toPandas())
        hats[bound] = pd.concat(parts).sort_values("a").hat.to_numpy()
        if bound > 1:
            own = pd.concat(parts)
            for p, score in group.scores([~m.trains for m in plan]).items():
                e = own[own.fold == p]
                assert math.isclose(score["rmse"], float(np.sqrt(((e.y - e.hat) ** 2).mean())), rel_tol=1e-9) and score["n"] == len(e)
                assert math.isclose(score["r2"], 1 - ((e.y - e.hat) ** 2).mean() / e.y.var(ddof=0), rel_tol=1e-9)
            assert {r.kind for r in group.table().collect()} == {"split", "leaf"}
    first, second = hats.values()
    assert np.array_equal(first, second)


def test_penalties_are_searched():
    drawn = candidates(8)
    assert {"l1", "l2"} <= set(RANGES) and len({c["l1"] for c in drawn}) == 8 and all(0.1 <= c["l2"] <= 30 for c in drawn)


def test_exact_quantiles_of_heavy_tails(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.standard_t(1, 3000) * 10.0 ** rng.integers(-300, 300, 3000), np.full(500, 1e300), [0.0, -0.0] * 250, [-1e-320, 5e-324]])
    d = pd.DataFrame({"g": rng.integers(0, 3, len(values)), "v": values})
    rows = spark.createDataFrame(d).repartition(4).union(spark.createDataFrame([(0, None), (9, None)], "g long, v double"))
    wanted = {"a": 0.05, "b": 0.5, "c": 0.95, "d": 0.0, "e": 1.0, "f": 0.333}
    got = {r.g: r.asDict() for r in quantiles.quantiles(rows, ["g"], "v", wanted).collect()}
    assert set(got) == {0, 1, 2}
    for g, row in got.items():
        own = d.v[d.g == g].to_numpy()
        assert all(math.isclose(row[c], np.quantile(own, q), rel_tol=1e-12) for c, q in wanted.items())
    lower = quantiles.quantiles(rows, [], "v", {"m": 0.3}, between=False).first().m
    assert lower == np.quantile(values, 0.3, method="lower")
    assert quantiles.quantiles(rows.where("g > 5"), ["g"], "v", wanted).count() == 0


def test_levels_agree_with_and_without_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(21)
    d = pd.DataFrame({"a": rng.normal(size=900), "b": rng.integers(0, 9, 900).astype(float), "s": rng.choice(["u", "v"], 900), "fold": rng.integers(0, 2, 900)})
    d["y"] = np.sin(3 * d.a) + d.b * np.where(d.s == "u", 1, -1)
    rows, k = boosted.coded(spark.createDataFrame(d).withColumn("_cell", F.col("fold")), ["s"])
    plan = [boosted.Model(0, np.array([f != t for f in range(2)]), {"trees": 7, "depth": 3}) for t in range(2)]
    monkeypatch.setattr(boosted, "RENEW", 3)
    tables = []
    for direct, cells in ((boosted.DIRECT, boosted.CELLS), (0, 1)):
        monkeypatch.setattr(boosted, "DIRECT", direct)
        monkeypatch.setattr(boosted, "CELLS", cells)  # a model a range
        (_, _, group), = boosted.grown(rows, ["a", "b"], ["y"], plan, k)
        tables.append(sorted(map(str, group.table().collect())))
    assert tables[0] == tables[1] and len(tables[0]) > 7 * 4 * 8


@pytest.mark.parametrize("cost", ["pairs", "halves"])
def test_sisters_pairs_and_replayed_trees_give_the_same_trees(spark, monkeypatch, cost):
    """Blocks of one stratum, counted by pairs of features and smaller sisters, against rows counted one by one without a parent's sums."""
    rng = np.random.default_rng(31)
    d = pd.DataFrame({"a": rng.normal(size=6000), "b": rng.integers(0, 9, 6000).astype(float), "c": rng.normal(size=6000), "s": rng.choice(["u", "v"], 6000, p=[0.9, 0.1]), "fold": rng.integers(0, 3, 6000)})
    d["y"] = np.sin(3 * d.a) + d.b * np.where(d.s == "u", 1, -1) + d.c**2
    rows, k = boosted.coded(spark.createDataFrame(d).withColumn("_cell", F.col("fold")), ["s"])
    plan = [boosted.Model(0, np.array([f != t for f in range(3)]), s) for t in range(3) for s in ({"trees": 6, "depth": 3}, {"trees": 3, "depth": 2, "row_share": 0.8})]
    monkeypatch.setattr(boosted, "BINS", 16)
    if cost == "halves":
        monkeypatch.setattr(boosted, "EXACT", 0)
    tables, seen, count = [], [], boosted.counted
    monkeypatch.setattr(boosted, "counted", lambda features, *a: seen.append(len(features)) or count(features, *a))
    for alone, hold, direct in ((500, 4, boosted.DIRECT), (1 << 30, 1, 0)):
        monkeypatch.setattr(boosted, "ALONE", alone)
        monkeypatch.setattr(boosted, "HOLD", hold)
        monkeypatch.setattr(boosted, "DIRECT", direct)
        (_, _, group), = boosted.grown(rows, ["a", "b", "c"], ["y"], plan, k)
        tables.append(sorted(map(str, group.table().collect())))
    assert tables[0] == tables[1] and len(tables[0]) > 6 * 4 * 6


def test_sums_of_a_level_with_those_above(monkeypatch):
    """Only smaller sisters are counted, and the sums of all nodes are whole."""
    rng = np.random.default_rng(2)
    n, models = 60_000, 4
    group = object.__new__(boosted.Group)
    group.plan, group.features, group.strata = [boosted.Model(0, np.array([True]), {})] * models, list("abcd"), 1
    group.n_models, group.depth, group.seed, group.first = models, 3, 1, None
    group.of, group.trains, group.cuts = np.zeros(models, int), np.ones((models, 1), bool), [np.arange(63.0)] * 4
    group.params = [(0.0, 1.0, 0.0, 1.0)] * models
    tree = boosted.Trees(models, 3)
    tree.feature[:], tree.cut[:] = rng.integers(0, 4, tree.feature.shape), rng.integers(20, 40, tree.cut.shape)
    bins, g = rng.integers(0, 64, (4, n)).astype(np.uint8), rng.integers(-(1 << 35), 1 << 35, (models, n))
    block = (np.zeros(1, np.int64), np.zeros(n, np.int32), None, bins, g)

    class State:
        getNumPartitions = lambda self: 1
        mapPartitions = lambda self, f: type("Met", (), {"collect": lambda _: list(f(iter([block])))})()

    sums, rows, seen, count = None, None, [], boosted.counted
    monkeypatch.setattr(boosted, "counted", lambda features, at, *a: seen.append(len(at) * len(features)) or count(features, at, *a))
    for level in range(3):
        seen.clear()
        found, sums = group.splits(State(), tree, 0, level, np.ones((models, 1 << level), bool), [[0, 1, 2, 3]] * models, sums, rows)
        assert sum(seen) <= models * n * 4 // (2 if level else 1)
        rows = np.zeros((models, 2 << level), np.int64)
        for m in range(models):
            node = tree.walk(bins.T, np.full(n, m), level + 1)
            rows[m] = np.bincount(node, minlength=2 << level)
            for f in range(4):
                at = (node >> 1) * 64 + bins[f]
                want = np.zeros((1 << level) * 64, np.int64)
                np.add.at(want, at, g[m])
                assert np.array_equal(sums[0][m, :, f].ravel(), want) and np.array_equal(sums[1][m, :, f].ravel(), np.bincount(at, minlength=len(want)))
