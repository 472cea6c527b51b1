"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted lists.

Terms are all words of the labelled examples (lower-cased A-Z, as 64-bit hashes); none is left out.  A term weighs
(1 + ln tf) * ln(1 + n / df) * rf, where rf = log2(2 + a / max(1, b)) is the relevance frequency: a toxic and b other
examples hold the term, so words that mark toxic texts weigh more and no word weighs nothing.  A word no example
holds counts in a text's length only (df 1, rf 1).  Weights are scaled to length 1 per text.

Fitting uses at most ``MAX_EXAMPLES`` labelled documents with ``MAX_POSTINGS`` distinct words in all (in the order of their
ids' hashes; rows that are held out are never used), so the index has a proven bound and is broadcast.  Equal texts
count as one example.

Search, many texts at once: examples lie in blocks of ``BLOCK`` that are alike.  The lists of all but the ``LONG`` most
frequent terms are short and read whole.  The long lists are stored by block, and a block's largest weight of each
bounds what they can add; a text opens only blocks whose bound (short lists as read, long ones at most) reaches
its k-th best cosine so far, best bounds first.  So the ``NEIGHBOURS`` nearest are exact; ties (at six decimals)
go to the smaller id.

The vote is the cosine-weighted share of toxic neighbours, drawn to the base rate by ``PRIOR``.  A logistic curve fitted
to the leave-one-out votes of the examples makes it the score; the neighbours and their cosines are the evidence.

Defined cases: null or empty text, or one that shares no word with an example, gets the base rate and no neighbours, and
``reject`` keeps texts without words; null ids are carried through and never used for fitting; label rows with a null
are ignored, several rows of one id vote (a tie is toxic); with no labelled examples every score is 0; repeated rows
are scored each; a very long text is one row of a batch like any other; an empty table gives an empty result; other
columns are neither read nor returned (``reject`` keeps them, whatever their names).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import Words, slices, spread, utf8
from .tables import bounded_batches, saved, table, text_rows

MAX_EXAMPLES, MAX_POSTINGS = 8_000, 3_000_000
LONG, BLOCK, TEXTS = 512, 64, 128
NEIGHBOURS, PRIOR, CUT = 50, 0.5, 0.7
SLACK = 1e-5  # of single-precision sums
SCORED = "doc_id long, score double, neighbours array<long>, cosines array<float>"


def counted(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word hash, count) of a slice, sorted."""
    doc = np.searchsorted(w.doc, np.arange(len(w)), "right") - 1
    order = np.lexsort((w.hash, doc))
    term, doc = w.hash[order], doc[order]
    first = np.ones(len(term), bool)
    first[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return doc[at], term[at], np.diff(np.append(at, len(term)))


def alike(x: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which blocks of ``size`` rows are alike: halves along the direction of most spread."""
    parts, done = [np.arange(len(x))], []
    while parts:
        own = parts.pop()
        if len(own) <= size:
            done.append(own)
            continue
        centred = x[own] - x[own].mean(0)
        axis = centred[np.argmax((centred * centred).sum(1))]
        for _ in range(4):
            axis = centred.T @ (centred @ axis)
            axis = axis / max(1e-12, float(np.linalg.norm(axis)))
        half = max(1, round(len(own) / 2 / size)) * size
        order = own[np.argsort(centred @ axis, kind="stable")]
        parts += [order[half:], order[:half]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


class Index:
    """The labelled examples: short lists by term, long lists by block, and each block's largest weights."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS, long: int = LONG, block: int = BLOCK):
        n, self.k, self.block = len(ids), k, block
        self.base = float(labels.mean()) if n else 0.0
        self.names, term = np.unique(terms, return_inverse=True)
        term, owner = term.astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), lengths)
        df = np.bincount(term, minlength=len(self.names))
        toxic = np.bincount(term, labels[owner], len(self.names))
        self.novel = float(np.log1p(n))  # of a word without a list
        self.gain = np.log1p(n / np.maximum(df, 1)) * np.log2(2 + toxic / np.maximum(1, df - toxic))
        weight = ((1 + np.log(counts)) * self.gain[term]).astype(np.float32)
        size = np.sqrt(np.bincount(owner, weight * weight, n))
        weight /= np.maximum(size, 1e-12)[owner].astype(np.float32)
        frequent = np.sort(np.argsort(-df, kind="stable")[:long])
        self.long = np.full(len(self.names), -1, np.int32)
        self.long[frequent] = np.arange(len(frequent), dtype=np.int32)
        far = self.long[term] >= 0
        self.far = (owner[far], self.long[term[far]].astype(np.int16), weight[far])
        order = alike(self.spelt(n, len(frequent)), self.block)
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        self.far = (place[self.far[0]], *self.far[1:])
        self.ids, self.labels, self.n_long = ids[order], labels[order].astype(np.float64), len(frequent)
        near = np.flatnonzero(~far)
        near = near[np.argsort(term[near].astype(np.int64) * max(1, n) + place[owner[near]], kind="stable")]
        self.row, self.weight = place[owner[near]], weight[near]
        self.start = np.searchsorted(term[near], np.arange(len(self.names) + 1)).astype(np.int32)
        self.open()

    def spelt(self, n: int, n_long: int) -> np.ndarray:
        out = np.zeros((n, n_long), np.float32)
        out[self.far[0], self.far[1]] = self.far[2]
        return out

    def open(self) -> None:
        """The long lists by block; they travel as lists."""
        n = len(self.ids)
        self.dense, self.edges = self.spelt(n, self.n_long), np.arange(0, n, self.block)
        self.most = np.maximum.reduceat(self.dense, self.edges, axis=0).T.copy() if n else np.zeros((0, 0), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("dense", "most")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.open()

    def nearest(self, doc: np.ndarray, term: np.ndarray, count: np.ndarray, size: int, extra: int = 0) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each of ``size`` texts the places and cosines of its k (and ``extra``) nearest examples, best first."""
        n, k = len(self.ids), self.k + extra
        if not n or not len(term):
            return [np.zeros(0, np.int64)] * size, [np.zeros(0)] * size
        at = np.searchsorted(self.names, term)
        at[at == len(self.names)] = 0
        known = self.names[at] == term
        weight = (1 + np.log(count)) * np.where(known, self.gain[at], self.novel)
        weight = weight / np.sqrt(np.bincount(doc, weight * weight, size))[doc]
        doc, at, weight = doc[known], at[known], weight[known]
        far = self.long[at] >= 0
        asked = np.zeros((size, self.dense.shape[1]), np.float32)
        asked[doc[far], self.long[at[far]]] = weight[far]
        doc, at, weight = doc[~far], at[~far], weight[~far]
        many = self.start[at + 1] - self.start[at]
        place = spread(self.start[at], many)
        sums = np.bincount(np.repeat(doc * n, many) + self.row[place], np.repeat(weight, many) * self.weight[place], size * n).reshape(size, n).astype(np.float64, copy=False)
        bound = np.maximum.reduceat(sums, self.edges, axis=1) + asked @ self.most
        least, visited = np.zeros(size), np.zeros(bound.shape, bool)
        # first each text's most promising blocks, which give its k-th best so far; then every block that can reach that
        first = np.argpartition(-bound, min(bound.shape[1], 2 * -(-k // self.block)) - 1, axis=1)[:, : 2 * -(-k // self.block)]
        turn = np.zeros(bound.shape, bool)
        np.put_along_axis(turn, first, True, axis=1)
        for _ in range(2):
            turn &= (bound >= least[:, None] - SLACK) & (bound > SLACK)
            for b in np.flatnonzero(turn.any(0)).tolist():
                own, a, z = np.flatnonzero(turn[:, b]), b * self.block, min(n, (b + 1) * self.block)
                if len(own) == size:
                    sums[:, a:z] += asked @ self.dense[a:z].T
                else:
                    sums[own, a:z] += asked[own] @ self.dense[a:z].T
            visited |= turn
            for q in range(size):
                done = sums[q, np.repeat(visited[q], self.block)[:n]]
                least[q] = np.partition(done, len(done) - k)[len(done) - k] if len(done) > k else 0.0
            turn = ~visited
        places, cosines = [], []
        for q in range(size):
            inside = np.repeat(visited[q], self.block)[:n]
            own = np.flatnonzero(inside & (sums[q] >= max(least[q] - 1e-6, 1e-9)))
            cosine = np.round(sums[q, own], 6)
            first = np.lexsort((self.ids[own], -cosine))[:k]
            places.append(own[first])
            cosines.append(cosine[first])
        return places, cosines

    def vote(self, place: np.ndarray, cosine: np.ndarray) -> float:
        return float((cosine @ self.labels[place] + PRIOR * self.base) / (cosine.sum() + PRIOR))


class Model(NamedTuple):
    """The broadcast index (at most MAX_EXAMPLES rows, MAX_POSTINGS numbers) and the calibration's intercept and slope."""

    index: Broadcast
    curve: tuple[float, float]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of y on x by Newton's method, with labels drawn to (n1 + 1) / (n1 + 2) and 1 / (n0 + 2)."""
    if not len(x):
        return 0.0, 0.0
    n1 = y.sum()
    y = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    design, beta = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        slope = design.T @ (y - p) - 1e-3 * beta
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), slope)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def examples(docs: DataFrame, labels: DataFrame, usable, limit: int, postings: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, toxic, terms, counts of at most ``limit`` labelled documents, equal texts once, ``postings`` terms in all; in the shared folder.

    In the order of their ids' hashes every text that still fits is taken.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).where("doc_id is not null and toxic is not null")
    named = named.where(usable(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    named = named.join(text_rows(docs, doc_id, text).where("text is not null").select("doc_id"), "doc_id", "left_semi")  # labels of absent documents take no place
    chosen = F.broadcast(named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))  # at most ``limit`` pairs of numbers
    met = text_rows(docs, doc_id, text).where("text is not null").join(chosen, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            terms, counts = [], []
            for i, j in slices(offsets):
                doc, term, count = counted(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                terms.extend(term[a:z].view(np.int64) for a, z in zip(edge[:-1], edge[1:], strict=True))
                counts.extend(count[a:z].astype(np.int32) for a, z in zip(edge[:-1], edge[1:], strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], ["name", "toxic", "terms", "counts"])

    name = F.struct("doc_id", F.sha2("text", 256).alias("h")).alias("name")
    found = met.select(name, "toxic", "text").mapInArrow(run, "name struct<doc_id:long,h:string>, toxic double, terms array<long>, counts array<int>")
    once = found.groupBy("name.h").agg(F.min("name.doc_id").alias("doc_id"), F.avg("toxic").alias("toxic"), F.first("terms").alias("terms"), F.first("counts").alias("counts"))
    once = saved(once.where(F.size("terms") > 0).select("doc_id", "h", (F.col("toxic") >= 0.5).cast("int").alias("toxic"), "terms", "counts"), "examples")
    left, fits = postings, []
    for r in once.orderBy(F.xxhash64("doc_id"), "doc_id", "h").select("doc_id", "h", F.size("terms").alias("n")).collect():  # at most ``limit`` rows of numbers
        if r["n"] <= left:  # a text over the rest of the bound is passed over, later ones may fit
            left -= r["n"]
            fits.append((r["doc_id"], r["h"]))
    within = F.broadcast(docs.sparkSession.createDataFrame(fits, "doc_id long, h string"))
    return once.join(within, ["doc_id", "h"], "left_semi").orderBy("doc_id", "h")


def fit(docs: DataFrame, labels: DataFrame, usable=lambda c: F.lit(True), limit: int = MAX_EXAMPLES, postings: int = MAX_POSTINGS, doc_id: str = "doc_id", text: str = "text", **shape: int) -> Model:
    """The index of the labelled documents; ``usable`` is a condition on their ids; ``shape``: k, long, block of the index."""
    spark = docs.sparkSession
    chosen = examples(docs, labels, usable, limit, postings, doc_id, text)
    shared = spark.sparkContext.broadcast(_index(chosen, shape))
    if not (n := len(shared.value.ids)):
        return Model(shared, (0.0, 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        where = {int(i): p for p, i in enumerate(own.ids)}
        for batch in batches:
            lists, ids, votes = batch.column(1), batch.column(0).to_pylist(), []
            for a in range(0, batch.num_rows, TEXTS):
                z = min(batch.num_rows, a + TEXTS)
                part = lists.slice(a, z - a)
                doc = np.repeat(np.arange(z - a), part.value_lengths().to_numpy(zero_copy_only=False))
                places, cosines = own.nearest(doc, part.flatten().to_numpy().view(np.uint64), batch.column(2).slice(a, z - a).flatten().to_numpy(), z - a, 1)
                for i, p, c in zip(ids[a:z], places, cosines, strict=True):
                    use = np.flatnonzero(p != where[i])[: own.k]
                    votes.append(own.vote(p[use], c[use]))
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column(3)], ["vote", "toxic"])

    bounded_batches(spark)
    parts = max(1, min(4 * spark.sparkContext.defaultParallelism, n // 256))
    votes = chosen.select("doc_id", "terms", "counts", "toxic").repartition(parts, "doc_id").mapInArrow(run, "vote double, toxic int").toPandas().sort_values(["vote", "toxic"])
    return Model(shared, logistic(votes["vote"].to_numpy(), votes["toxic"].to_numpy(np.float64)))


def _index(chosen: DataFrame, shape: dict[str, int]) -> Index:
    held = chosen.select("doc_id", "toxic", "terms", "counts").toArrow()  # at most MAX_EXAMPLES rows, MAX_POSTINGS numbers
    lists = held.column("terms").combine_chunks()
    terms, counts = lists.flatten().to_numpy().view(np.uint64), held.column("counts").combine_chunks().flatten().to_numpy()
    return Index(held.column("doc_id").to_numpy(), held.column("toxic").to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False), terms, counts, **shape)


def _scores(model: Index, curve: tuple[float, float], column: pa.Array) -> Iterator[tuple[float, np.ndarray, np.ndarray, bool]]:
    """(score, nearest ids, cosines, has words) of each text."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        doc, term, count = counted(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        edge = np.searchsorted(doc, np.arange(j - i + 1))
        for a in range(0, j - i, TEXTS):
            z = min(j - i, a + TEXTS)
            lo, hi = edge[a], edge[z]
            places, cosines = model.nearest(doc[lo:hi] - a, term[lo:hi], count[lo:hi], z - a)
            for d, p, c in zip(range(a, z), places, cosines, strict=True):
                chance = 1 / (1 + math.exp(-min(40.0, max(-40.0, curve[0] + curve[1] * model.vote(p, c))))) if len(p) else model.base
                yield chance, model.ids[p], c, bool(edge[d + 1] > edge[d])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, and the ids and cosines of the nearest examples, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_scores(model.index.value, model.curve, batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float32()))], ["doc_id", "score", "neighbours", "cosines"])

    return text_rows(docs, doc_id, text).mapInArrow(run, SCORED)


def reject(docs: DataFrame, model: Model, cut: float = CUT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is under the cut or whose text has no words, with all columns."""
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([r[0] < cut or not r[3] for r in _scores(model.index.value, model.curve, batch.column(where))], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def unheld(c):
    """Ids that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.pmod(F.crc32(c.cast("string")), F.lit(3)) != 1


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), unheld)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(~unheld(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "neighbours", "cosines")
