"""Gradient-boosted trees of many models at once: strata x targets x training conditions grow together, level by level.

Features are cut once into bins at exact quantiles.  A level of a tree takes one pass over the rows: every task counts rows
and sums gradients by (model, node, feature, bin) with NumPy, the sums are added by a shuffle of those small rows, and each node's
split is chosen where its sums meet; only the chosen splits come to the driver.  A row trains every model whose condition
it meets, so folds and targets need no copies of the rows.  Features are counted in pairs, whose sums give those of either; of two sisters
only the smaller is counted where the sums of their parent are at hand.

Targets, predictions and gradients are whole numbers of a small unit, so sums do not depend on the order of rows, tasks or
retries, and the same trees grow everywhere (doubles add them only where all sums are exact).  The objective is the squared error with penalties on leaves (``l1``, ``l2``), a
least gain and least rows of a split, and shares of rows and columns for each tree.  Rows, with their gradients so far, are blocks
of matrices that stay with the tasks (in memory, else on disk), so that a pass reads no table; they are written to the shared folder every ``RENEW``
trees, and a lost executor repeats its part of the trees since.

What is broadcast is bounded: models are grown in groups so that trees, counts and a row's predictions stay below
``MAX_NODES``, ``MAX_CELLS`` and ``MAX_PLAN``.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch
from .quantiles import quantiles

#: The least number of trees and depth that the reference searches; the others are usual ones.
SETTING = {"trees": 300, "depth": 3, "rate": 0.1, "least_rows": 1.0, "least_gain": 0.0, "row_share": 1.0, "column_share": 1.0, "l1": 0.0, "l2": 1.0}
BINS, RENEW, HOLD = 64, 50, 2  # HOLD: trees of little depth that passes walk again before gradients are kept
SHARE, CELLS = 100_000, 200_000  # a task's rows times models (of a small table), and its cells of the histogram
DIRECT = 1 << 21  # cells of all tasks' histograms that meet without a shuffle (32 MB)
MAX_NODES, MAX_CELLS, MAX_PLAN, MAX_STRATA = 4_000_000, 1 << 22, 128, 100_000
MOST_BITS = 36
Sums = tuple[np.ndarray, np.ndarray]  # of gradients and rows by model, node, feature and bin
BLOCK, ALONE, APART = 1 << 22, 1 << 12, 16  # gradients of a block; rows from which a stratum has blocks of its own; nodes looked at one by one
HELD = 1 << 28  # bytes of a task's blocks
EXACT = 1 << 53
Block = tuple[np.ndarray, ...]  # stratum (one if all rows have the same), cell and key of some rows, bins by feature, gradients by model


@dataclass(frozen=True)
class Model:
    """A model of every stratum: its target, the cells of folds whose rows train it, and its setting."""

    target: int
    trains: np.ndarray  # bool by cell
    setting: dict

    def __getitem__(self, name: str) -> float:
        return (SETTING | self.setting)[name]


def edges_of(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Cut points of each feature: its different lower quantiles at 1/bins, 2/bins, ..."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("x")) for i, c in enumerate(features)))).alias("f")).select("f.*")
    found = quantiles(long, ["feature"], "x", {f"q{i}": i / bins for i in range(1, bins)}, between=False)
    held = {r["feature"]: np.unique(np.array(r[1:], float)) for r in found.collect()}  # a row a feature
    return [held.get(i, np.zeros(0)) for i in range(len(features))]


def units_of(rows: DataFrame, targets: list[str]) -> list[tuple[float, float]]:
    """(least value, unit) of each target: its range is under 2 ** bits units, and sums of all rows fit in 64 bits."""
    r = rows.agg(F.count("*").alias("n"), *(f(t).alias(f"{f.__name__}{i}") for i, t in enumerate(targets) for f in (F.min, F.max))).first()
    bits = min(MOST_BITS, 61 - math.ceil(math.log2(r["n"] + 1)))
    out = []
    for i in range(len(targets)):
        low, high = r[f"min{i}"], r[f"max{i}"]
        wide = 2.0 ** math.ceil(math.log2(high - low)) if low is not None and high > low else 1.0
        out.append((float(low or 0.0), wide / 2.0**bits))
    return out


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Shares in [0, 1) from row hashes and a seed."""
    x = x.view(np.uint64) ^ np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def seed_of(*parts: object) -> int:
    return int.from_bytes(hashlib.md5(":".join(map(str, parts)).encode()).digest()[:8], "little")


def columns_of(model: int, tree: int, n_features: int, share: float, seed: int) -> list[int]:
    """The features that a tree may split on."""
    order = sorted(range(n_features), key=lambda f: seed_of(seed, "columns", model, tree, f))
    return sorted(order[: max(1, math.ceil(share * n_features))])


class Trees:
    """Trees of all models of a group, in heap order; a node without a split sends its rows left."""

    def __init__(self, models: int, depth: int):
        self.depth = depth
        self.feature = np.full((models, (1 << depth) - 1), -1, np.int16)
        self.cut = np.full((models, (1 << depth) - 1), 255, np.uint8)
        self.leaf = np.zeros((models, 1 << depth), np.int64)

    def walk(self, bins: np.ndarray, model: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row, numbered within the level ``depth``."""
        node, row = np.zeros(len(model), np.int64), np.arange(len(model))
        for level in range(depth):
            at = (1 << level) - 1 + node
            node = 2 * node + (bins[row, np.maximum(self.feature[model, at], 0)] > self.cut[model, at])
        return node

    def walk_one(self, bins: np.ndarray, model: int, depth: int) -> np.ndarray:
        """The same of rows of one model; ``bins`` has a line a feature."""
        node, row = np.zeros(bins.shape[1], np.uint8 if depth <= 8 else np.int64), None
        for level in range(depth):
            first = (1 << level) - 1
            feature, cut = self.feature[model, first : 2 * first + 1], self.cut[model, first : 2 * first + 1]
            cuts = np.flatnonzero(feature >= 0)
            if len(cuts) <= APART:
                right = np.zeros(len(node), bool)
                for k in cuts.tolist():
                    over = bins[feature[k]] > cut[k]
                    right |= over & (node == k) if level else over
            else:
                row = np.arange(len(node)) if row is None else row
                right = bins[np.maximum(feature, 0)[node], row] > cut[node]
            node += node
            node += right
        return node


def exact_parts(g: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Doubles and the unit of each, whose sums over any of the rows are exact: the gradients, or their upper and lower bits."""
    if not len(g) or max(int(g.max()), -int(g.min())) * len(g) < EXACT:
        return [(g.astype(float), 1)]
    return [((g >> 20).astype(float), 1 << 20), ((g & ((1 << 20) - 1)).astype(float), 1)]


def shut(block: Block) -> Block:
    """The block as it is kept: gradients in five bytes, where they fit."""
    g = block[4]
    if g.size and not -(1 << 39) <= int(g.min()) <= int(g.max()) < 1 << 39:
        return block
    return *block[:4], g.astype(np.uint32), (g >> 32).astype(np.int8)


def opened(block: Block) -> Block:
    """The block with gradients of its own."""
    return *block[:4], block[4].copy() if len(block) == 5 else (block[5].astype(np.int64) << 32) | block[4]


def runs(cell: np.ndarray) -> np.ndarray:
    """Where runs of equal cells begin, and the end."""
    return np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell))


def stretches(chosen: np.ndarray, bound: np.ndarray) -> list[slice]:
    """The rows of the chosen ones of neighbouring runs, which end at ``bound[1:]``, as few stretches."""
    edge = bound[np.flatnonzero(np.diff(chosen, prepend=False, append=False))]
    return [slice(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def joint(bins: np.ndarray, width: int) -> list[tuple[list[int], np.ndarray, int]]:
    """Pairs of features with the number of each row's pair of bins and how many there are."""
    return [([f, f + 1], bins[f].astype(np.int64) * width + bins[f + 1], width * width) if f + 1 < len(bins) else ([f], bins[f].astype(np.int64), width) for f in range(0, len(bins), 2)]


def counted(features: list[int], at: np.ndarray, size: int, parts: list[tuple[np.ndarray, int]], g: np.ndarray, n: np.ndarray | None) -> None:
    """Adds sums of gradients, and counts, of a pair's features to those of a node (by feature and bin)."""
    for into, found in ((g, [(np.bincount(at, w, size), unit) for w, unit in parts]), (n, [] if n is None else [(np.bincount(at, minlength=size), 1)])):
        for x, unit in found:
            x = x.astype(np.int64).reshape([g.shape[1]] * len(features)) * unit
            for k, f in enumerate(features):
                into[f] += x.sum(axis=1 - k) if len(features) > 1 else x


def _binned(columns: list[pa.Array], cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x.to_numpy(zero_copy_only=False), "right").astype(np.uint8) for c, x in zip(cuts, columns, strict=True)], axis=1)


class Group:
    """Models of some strata (code 0, 1, ...) and some entries of the plan, grown together.

    ``rows`` have ``_code`` and ``_cell`` (the number of a row's cell of folds) beside features and targets, all complete.
    """

    def __init__(self, rows: DataFrame, features: list[str], targets: list[str], plan: list[Model], strata: int, cuts: list[np.ndarray], units: list[tuple[float, float]], seed: int):
        self.rows, self.features, self.targets, self.plan, self.strata = rows, features, targets, plan, strata
        self.cuts, self.units, self.seed = cuts, units, seed
        self.n_models, self.depth = strata * len(plan), int(max(m["depth"] for m in plan))
        self.n_trees = int(max(m["trees"] for m in plan))
        self.of = np.array([m.target for m in plan])
        self.trains = np.stack([m.trains for m in plan])
        self.trees: list[Trees] = []
        self.first: np.ndarray | None = None
        self.params = [(float(m["l1"]) / units[m.target][1], float(m["l2"]), float(m["least_gain"]) / units[m.target][1] ** 2, float(m["least_rows"])) for m in plan]

    def start(self) -> RDD:
        """Blocks of all rows; predictions begin at the mean of a model's training rows."""
        cuts, units, n_f, n_t = self.cuts, self.units, len(self.features), len(self.targets)
        whole = [F.floor((F.col(t).cast("double") - F.lit(low)) / F.lit(unit) + 0.5).cast("long").alias(f"_y{i}") for i, (t, (low, unit)) in enumerate(zip(self.targets, units, strict=True))]
        own = self.rows.select("_code", F.col("_cell").cast("int"), F.xxhash64(*self.rows.columns).alias("_key"), *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(self.features)), *whole)
        sums = own.groupBy("_code", "_cell").agg(F.count("*").alias("n"), *(F.sum(f"_y{i}").alias(f"s{i}") for i in range(n_t))).collect()  # strata x folds
        count, total = [0] * self.n_models, [0] * self.n_models
        for r in sums:
            for p, m in enumerate(self.plan):
                if self.trains[p, r["_cell"]]:
                    count[r["_code"] * len(self.plan) + p] += r["n"]
                    total[r["_code"] * len(self.plan) + p] += int(r[f"s{m.target}"])
        self.count = np.array(count, np.int64)
        base = np.array([t // n if n else 0 for t, n in zip(total, count, strict=True)], np.int64)
        self.base, n_plan = base, len(self.plan)

        of, keyed, full = self.of, any(m["row_share"] < 1 for m in self.plan), max(1, min(1 << 16, BLOCK // n_plan))

        def blocks(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = pa.Table.from_batches(batches).combine_chunks()
            code, cell = b.column(0).to_numpy(), b.column(1).to_numpy()
            bins = np.ascontiguousarray(_binned(b.columns[3 : 3 + n_f], cuts).T)
            y = np.stack([b.column(3 + n_f + i).to_numpy().astype(np.int64) for i in range(n_t)])
            found, at, size = np.unique(code, return_inverse=True, return_counts=True)
            at = np.where(size >= ALONE, np.arange(len(found)), -1)[at]  # small strata share a block
            for own in np.unique(at):
                row = np.flatnonzero(at == own)
                row = row[np.argsort(cell[row], kind="stable")]
                g = base.reshape(-1, n_plan)[code[row]].T - y[of][:, row]
                held = (code[row[:1] if own >= 0 else row].astype(np.int64), cell[row], b.column(2).to_numpy()[row] if keyed else None, bins[:, row], np.ascontiguousarray(g))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(shut(held))], pa.binary())], names=["block"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for b in batches:
                held.append(b)
                n += b.num_rows
                if n >= full:
                    yield from blocks(held)
                    held, n = [], 0
            if n:
                yield from blocks(held)

        # a task's share: small tables are not worth many tasks a pass, large ones are dealt evenly
        total_rows, spark = sum(r["n"] for r in sums), self.rows.sparkSession
        parts = max(1, min(-(-total_rows * n_plan // SHARE), spark.sparkContext.defaultParallelism), -(-total_rows * n_plan * 8 // HELD))
        path = scratch(spark, "boosted")
        own.repartition(parts, "_key").mapInArrow(run, "block binary").write.parquet(path)
        return spark.read.schema("block binary").parquet(path).rdd.map(lambda r: pickle.loads(r[0]))

    def _light(self) -> Group:
        """What tasks need: no rows, no finished trees."""
        own = object.__new__(Group)
        for name in ("of", "trains", "depth", "seed"):
            setattr(own, name, getattr(self, name))
        own.n_features = len(self.features)
        own.shares = [float(m["row_share"]) for m in self.plan]
        own.n_bins = max([1, *(len(c) + 1 for c in self.cuts)])
        return own

    def advanced(self, block: Block, tree: Trees) -> Block:
        """The block with the tree's steps added to its gradients, in place."""
        code, cell, key, bins, g = block
        bound, n_plan = runs(cell), len(self.of)
        for p in range(n_plan):
            if len(code) == 1:
                model = int(code[0]) * n_plan + p
                for own in stretches(self.trains[p, cell[bound[:-1]]], bound):
                    g[p, own] += tree.leaf[model].take(tree.walk_one(bins[:, own], model, tree.depth))
            else:
                model = code * n_plan + p
                g[p] += tree.leaf[model, tree.walk(bins.T, model, tree.depth)]
        return block

    def splits(self, state: RDD, tree: Trees, number: int, level: int, open_: np.ndarray, allowed: list[list[int]], above: Sums | None = None, rows: np.ndarray | None = None) -> tuple[list[tuple], Sums | None]:
        """model, node, g, n and the best split (feature, bin: up to it rows go left; gl, nl) of every open node, feature -1 where none gains enough; and the sums, where they came.

        Every task sums gradients and counts by model, node of the level, feature and bin.  Histograms of few tasks are added as
        they come; others meet by ranges of models in a shuffle, and only the chosen splits come to the driver.  With the sums of the
        level ``above`` and the ``rows`` of each node only the smaller of two sisters is counted.
        """
        task, n_plan = self._light(), len(self.plan)
        size = (self.n_models, 1 << level, task.n_features, task.n_bins)
        params, mask, width = np.array(self.params, float), np.zeros((n_plan, task.n_features), bool), math.prod(size[1:])
        for p, a in enumerate(allowed):
            mask[p, a] = True
        step = max(1, CELLS // width)  # models of a range
        direct = state.getNumPartitions() * math.prod(size) <= DIRECT
        known = direct and not level and self.first is not None  # every row is in a tree: the counts above its first split are always the same
        wanted, other = open_, None
        if direct and above is not None:
            smaller = np.stack([rows[:, ::2] <= rows[:, 1::2], rows[:, ::2] > rows[:, 1::2]], axis=2).reshape(open_.shape)
            wanted, other = open_ & smaller, np.nonzero(open_ & ~smaller)

        def sums(blocks: Iterator[Block]) -> tuple[np.ndarray, np.ndarray]:
            g_sum, n_sum = np.zeros(math.prod(size), np.int64), np.zeros(math.prod(size), np.int64)
            for code, cell, key, bins, g in blocks:
                alone, pairs = len(code) == 1, None
                bound = runs(cell)
                for p in range(n_plan):
                    nodes = np.flatnonzero(wanted[int(code[0]) * n_plan + p]) if alone else None
                    if alone and not len(nodes):
                        continue
                    row = np.repeat(task.trains[p, cell[bound[:-1]]], np.diff(bound))
                    if task.shares[p] < 1:
                        row = row & (mixed(key, seed_of(task.seed, "rows", p, number)) < task.shares[p])
                    if alone and len(nodes) <= APART:
                        model, pairs = int(code[0]) * n_plan + p, pairs or joint(bins, size[3])
                        node = tree.walk_one(bins, model, level) if level else None
                        for k in nodes.tolist():
                            whole = not level and task.shares[p] == 1
                            for own in stretches(task.trains[p, cell[bound[:-1]]], bound) if whole else [np.flatnonzero(row & (node == k) if level else row)]:
                                part = exact_parts(g[p][own])
                                few = len(part[0][0]) <= size[3] * size[3]
                                for f, x, n in [([f], bins[f], size[3]) for f in range(size[2])] if few else pairs:
                                    counted(f, x[own], n, part, g_sum.reshape(size)[model, k], None if known else n_sum.reshape(size)[model, k])
                        continue
                    row = np.flatnonzero(row)
                    model = (code if len(code) == 1 else code[row]) * n_plan + p
                    model = np.broadcast_to(model, len(row))
                    mine = bins[:, row].T
                    node = tree.walk(mine, model, level)
                    live = wanted[model, node]
                    row, mine, model, node = row[live], mine[live], model[live], node[live]
                    if not len(row):
                        continue
                    at = ((model * size[1] + node) * size[2])[:, None] + np.arange(size[2])
                    at = (at * size[3] + mine).ravel()
                    low, spread = int(at.min()), int(at.max()) + 1  # the models of the block's strata
                    at -= low
                    for part, unit in exact_parts(g[p, row]):
                        g_sum[low:spread] += np.bincount(at, np.repeat(part, size[2]), spread - low).astype(np.int64) * unit
                    if not known:
                        n_sum[low:spread] += np.bincount(at, minlength=spread - low)
            return g_sum, n_sum

        def best(first: int, g: np.ndarray, n: np.ndarray) -> list[tuple]:
            at = np.flatnonzero(n)
            model, node, feature, bins = np.unravel_index(at + first * width, size)
            return list(zip(*(x.tolist() for x in best_splits(model, node, feature, bins, g[at], n[at], params, mask)), strict=True)) if len(at) else []

        if direct:
            g, n = (sum(x) for x in zip(*state.mapPartitions(lambda blocks: [sums(blocks)]).collect(), strict=True))
            if not level and min(task.shares) == 1:
                self.first = n if self.first is None else self.first
                n = np.where(open_[..., None, None], self.first.reshape(size), 0).ravel()
            held = g.reshape(size), n.reshape(size)
            if other is not None:
                model, node = other
                for x, x_above in zip(held, above, strict=True):
                    x[model, node] = x_above[model, node >> 1] - x[model, node ^ 1]
            return best(0, g, n), held

        def ranges(blocks: Iterator[Block]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
            g, n = sums(blocks)
            for m in range(0, size[0], step):
                if n[m * width : (m + step) * width].any():
                    yield m, (g[m * width : (m + step) * width], n[m * width : (m + step) * width])

        met = state.mapPartitions(ranges).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), max(1, -(-size[0] // step)))
        return met.flatMap(lambda x: best(x[0], *x[1])).collect(), None  # a row a node

    def grow(self) -> None:
        """All trees; blocks with their gradients are kept every few trees until the next are made, and written every RENEW trees."""
        state, before, task = self.start().persist(StorageLevel.MEMORY_AND_DISK), [], self._light()
        kept, state, hold = state, state.map(opened), HOLD if self.depth <= 3 else 1
        n_plan, n_f = len(self.plan), len(self.features)
        depth = np.tile([int(m["depth"]) for m in self.plan], self.strata)
        upto = np.tile([int(m["trees"]) for m in self.plan], self.strata)
        rate = np.tile([float(m["rate"]) for m in self.plan], self.strata)
        l1 = np.tile([float(m["l1"]) / self.units[m.target][1] for m in self.plan], self.strata)
        l2 = np.tile([float(m["l2"]) for m in self.plan], self.strata)
        for number in range(self.n_trees):
            tree = Trees(self.n_models, self.depth)
            allowed = [columns_of(p, number, n_f, m["column_share"], self.seed) for p, m in enumerate(self.plan)]
            open_, sums, rows = ((self.count > 0) & (upto > number))[:, None], None, None
            for level in range(self.depth):
                if not open_.any():
                    break
                found, sums = self.splits(state, tree, number, level, open_, allowed, sums, rows)
                while before:  # the state is made now
                    before.pop().unpersist()
                after, rows = np.zeros((self.n_models, 2 << level), bool), np.zeros((self.n_models, 2 << level), np.int64)
                for m, node, g_all, n_all, feature, bin_, gl, nl in found:
                    sides = ((2 * node, gl, nl), (2 * node + 1, g_all - gl, n_all - nl)) if feature >= 0 else ((2 * node, g_all, n_all),)
                    if feature >= 0:
                        tree.feature[m, (1 << level) - 1 + node], tree.cut[m, (1 << level) - 1 + node] = feature, bin_
                        after[m, [2 * node, 2 * node + 1]] = level + 1 < depth[m]
                    for side, g, n in sides:  # the leftmost leaf below, unless a later level splits it
                        rows[m, side] = n
                        tree.leaf[m, side << (self.depth - level - 1)] = leaf(g, n, l1[m], l2[m], rate[m])
                open_ = after
            self.trees.append(tree)
            if number + 1 < self.n_trees:
                state = state.map(lambda block, task=task, tree=tree: task.advanced(block, tree))
                if (number + 1) % RENEW == 0:
                    path = scratch(self.rows.sparkSession, "boosted")
                    state.map(shut).saveAsPickleFile(path, 1)
                    state = self.rows.sparkSession.sparkContext.pickleFile(path).map(opened)
                if (number + 1) % RENEW == 0 or (number + 1) % hold == 0:
                    before.append(kept)
                    kept = state.map(shut).persist(StorageLevel.MEMORY_AND_DISK)
                    state = kept.map(opened)
        for held in (*before, kept):
            held.unpersist()

    def table(self) -> DataFrame:
        """stratum, entry, tree, kind, node, feature, below (rows under it go left), value: the trees as rows.

        Splits are numbered in heap order and have a feature and its bound; leaves are numbered from the left and have the step
        that they add in the target's scale.
        """
        rows = []
        for i, t in enumerate(self.trees):
            for m in range(self.n_models):
                at = (m // len(self.plan), m % len(self.plan), i)
                rows += [(*at, "split", k, self.features[f], float(self.cuts[f][c]), None) for k, (f, c) in enumerate(zip(t.feature[m].tolist(), t.cut[m].tolist(), strict=True)) if f >= 0]
                rows += [(*at, "leaf", k, None, None, v * self.units[self.of[m % len(self.plan)]][1]) for k, v in enumerate(t.leaf[m].tolist()) if v]
        return self.rows.sparkSession.createDataFrame(rows, "stratum int, entry int, tree int, kind string, node int, feature string, below double, value double")

    def _hats(self) -> Hats:
        return Hats(self.cuts, self.units, self.trees, len(self.plan), self.base, self.count, self.of)

    def _working(self, df: DataFrame, *more: str) -> DataFrame:
        """Working columns (features, then ``more``) behind those of ``df``, so that names cannot clash."""
        return df.select("*", *(F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(self.features)), *(F.col(c).alias(f"_w{i}") for i, c in enumerate(more)))

    def predict(self, df: DataFrame, entries: dict[str, np.ndarray], cell: str) -> DataFrame:
        """``df`` with a column for each of ``entries`` (name: the plan's entry for each value of ``cell``); NaN without a model."""
        hats, width, n_f = self._hats(), len(df.columns), len(self.features)
        names, kinds = [*df.columns, *entries], df.select("*", *(F.lit(0.0).alias(c) for c in entries)).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    bins = _binned(b.columns[width : width + n_f], hats.cuts)
                    code, at = b.column(width + n_f).to_numpy(), b.column(width + n_f + 1).to_numpy()
                    yield pa.RecordBatch.from_arrays([*b.columns[:width], *(pa.array(hats.of_rows(bins, code, e[at])) for e in entries.values())], names=names)

        return self._working(df, "_code", cell).mapInArrow(run, kinds)

    def scores(self, held: list[np.ndarray]) -> dict[int, dict[str, float]]:
        """By entry of the plan: n, rmse, mae and r2 over the rows of its ``held`` cells (bool by cell)."""
        hats, n_f, n_t, out = self._hats(), len(self.features), len(self.targets), np.stack(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(out), 5))
            for b in batches:
                if not b.num_rows:
                    continue
                c = b.columns[-(n_f + n_t + 2) :]
                bins, code, cell = _binned(c[:n_f], hats.cuts), c[n_f].to_numpy(), c[n_f + 1].to_numpy()
                for p in range(len(out)):
                    row = np.flatnonzero(out[p, cell])
                    y = c[n_f + 2 + hats.of[p]].to_numpy(zero_copy_only=False)[row]
                    e = y - hats.of_rows(bins[row], code[row], np.full(len(row), p))
                    sums[p] += [len(y), (e * e).sum(), np.abs(e).sum(), y.sum(), (y * y).sum()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), *(pa.array(x) for x in sums.T)], names=["entry", "n", "ee", "e", "y", "yy"])

        found = self._working(self.rows, "_code", "_cell", *self.targets).mapInArrow(run, "entry long, n double, ee double, e double, y double, yy double")
        scores = {}
        for r in found.groupBy("entry").agg(*(F.sum(c).alias(c) for c in ("n", "ee", "e", "y", "yy"))).collect():
            n = r["n"]
            spread = r["yy"] - r["y"] * r["y"] / n if n else 0.0
            scores[r["entry"]] = {"rmse": math.sqrt(r["ee"] / n), "mae": r["e"] / n, "r2": 1 - r["ee"] / spread if spread > 0 else math.nan, "n": int(n)} if n else {"rmse": math.nan, "mae": math.nan, "r2": math.nan, "n": 0}
        return scores


@dataclass(frozen=True)
class Hats:
    """What a task needs to predict."""

    cuts: list[np.ndarray]
    units: list[tuple[float, float]]
    trees: list[Trees]
    n_plan: int
    base: np.ndarray
    count: np.ndarray
    of: np.ndarray

    def of_rows(self, bins: np.ndarray, code: np.ndarray, entry: np.ndarray) -> np.ndarray:
        model = code.astype(np.int64) * self.n_plan + entry
        hat = self.base[model]
        for t in self.trees:
            hat = hat + t.leaf[model, t.walk(bins, model, t.depth)]
        low, unit = np.array(self.units).T
        return np.where(self.count[model] > 0, low[self.of[entry]] + hat * unit[self.of[entry]], np.nan)


def leaf(g: int, n: int, l1: float, l2: float, rate: float) -> int:
    """The step of a leaf in units: minus the shrunken gradient over its rows and l2."""
    own = max(0.0, abs(float(g)) - l1)
    return int(math.floor(rate * -math.copysign(own, g) / (float(n) + l2) + 0.5))


def best_splits(model: np.ndarray, node: np.ndarray, feature: np.ndarray, bins: np.ndarray, g: np.ndarray, n: np.ndarray, params: np.ndarray, allowed: np.ndarray) -> list[np.ndarray]:
    """model, node, g, n, feature, bin, gl and nl of the best splits from whole histograms; ``params`` and ``allowed`` (bool by feature) have a row an entry of the plan."""
    order = np.lexsort((bins, feature, node, model))
    model, node, feature, bins, g, n = (x[order] for x in (model, node, feature, bins, g, n))
    fresh = lambda *keys: np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    run = fresh(model, node, feature)
    length = np.diff(np.concatenate([run, [len(g)]]))
    whole_g, whole_n = (np.repeat(np.add.reduceat(x, run), length) for x in (g, n))
    gl, nl = (np.cumsum(x) - np.repeat((np.cumsum(x) - x)[run], length) for x in (g, n))
    entry = model % len(params)
    l1, l2, least_gain, least_rows = params[entry].T

    def score(g: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.maximum(0.0, np.abs(g.astype(float)) - l1)
        return x * x / (n.astype(float) + l2)

    nr = whole_n - nl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(gl, nl) + score(whole_g - gl, nr) - score(whole_g, whole_n)
    gain[(nr <= 0) | (nl < least_rows) | (nr < least_rows) | ~(gain > least_gain) | ~allowed[entry, feature]] = -np.inf
    own = fresh(model, node)
    first = np.lexsort((bins, feature, -gain, node, model))[own]  # rows of a node stay together in any such order
    some = np.isfinite(gain[first])
    value = lambda x: np.where(some, x[first], -1)
    return [model[first], node[first], whole_g[first], whole_n[first], value(feature), value(bins), value(gl), value(nl)]


def coded(rows: DataFrame, strata: list[str]) -> tuple[DataFrame, int]:
    """Rows with ``_code``, the number of their stratum, and how many strata there are (at most MAX_STRATA)."""
    if not strata:
        return rows.withColumn("_code", F.lit(0)), 1
    found = sorted((tuple(r) for r in rows.select(*strata).distinct().limit(MAX_STRATA + 1).collect()), key=str)
    if len(found) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    kinds = dict(rows.dtypes)
    named = rows.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(found)], ", ".join([*(f"`{c}` {kinds[c]}" for c in strata), "_code int"]))
    return rows.join(F.broadcast(named), strata), len(found)


def groups(n_strata: int, plan: list[Model], n_features: int, together: int = 1, apart: bool = False) -> Iterator[tuple[range, list[int]]]:
    """Codes of strata and entries of the plan that may grow at once within the bounds.

    ``together`` neighbours of the plan stay together; with ``apart`` no others join them.
    """
    depth, trees = int(max(m["depth"] for m in plan)), int(max(m["trees"] for m in plan))
    most = max(1, min(MAX_NODES // (trees << (depth + 1)), MAX_CELLS // (n_features * BINS << (depth - 1))))
    width = together if apart else max(together, min(len(plan), MAX_PLAN, most) // together * together)
    for p in range(0, len(plan), width):
        entries = list(range(p, min(len(plan), p + width)))
        step = max(1, most // len(entries))
        for s in range(0, n_strata, step):
            yield range(s, min(n_strata, s + step)), entries


class Grower:
    """Grows groups of a plan; cuts and units are found once, when the first group needs them."""

    def __init__(self, rows: DataFrame, features: list[str], targets: list[str], plan: list[Model], seed: int = 42):
        self.rows, self.features, self.targets, self.plan, self.seed, self.scales = rows, features, targets, plan, seed, None

    def grow(self, codes: range, entries: list[int]) -> Group:
        """The group, which counts its codes from 0; ``rows`` as Group takes them."""
        self.scales = self.scales or (edges_of(self.rows, self.features), units_of(self.rows, self.targets))
        own = self.rows.where(F.col("_code").between(codes.start, codes.stop - 1)).withColumn("_code", F.col("_code") - codes.start)
        group = Group(own, self.features, self.targets, [self.plan[e] for e in entries], len(codes), *self.scales, self.seed)
        group.grow()
        return group


def grown(rows: DataFrame, features: list[str], targets: list[str], plan: list[Model], n_strata: int = 1, seed: int = 42, together: int = 1) -> Iterator[tuple[range, list[int], Group]]:
    """All grown groups with their codes and entries."""
    grower = Grower(rows, features, targets, plan, seed)
    for codes, entries in groups(n_strata, plan, len(features), together):
        yield codes, entries, grower.grow(codes, entries)
