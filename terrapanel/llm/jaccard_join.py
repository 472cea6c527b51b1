"""N-gram Jaccard self-join of documents by MinHash banding, verified on full n-gram sets.

A document's set holds its distinct n-grams of ``n`` words (lower-cased A-Z; a text of fewer words, but not none, is
one n-gram).  Documents with equal sets form a copy class that its least id stands for.  ``banding`` chooses bands and
rows from the threshold and the target recall: r rows and b bands give a pair at similarity s the chance
1 - (1 - s^r)^b to share a band (0.8 and 0.999: 23 bands of 6 rows).

Representatives that share a band hash form a bucket; buckets of the same members are one.  Pairs are verified on the full
sets in groups: a bucket, or a whole component of overlapping buckets where that takes fewer comparisons (components
are found from stars to each bucket's least id, never from all pairs).  Either way a pair is counted if it shares a
band, once, in the group of the first band it shares, so the way changes no result, and unlike texts that bands tie
into one large component are compared in their buckets only.  A group is cut into tiles of about ``TILE`` documents or
``TILE_NGRAMS`` n-grams and each pair of tiles is one task's group: its sets become rows of a matrix over the n-grams
that occur twice in it, and block products give all intersections.  A group returns a number of links for each
document and the stars of its linked parts, never pairs.  Linked stars of all groups form the classes.  Hot buckets,
hubs and copy classes are salted in joins.

Result: a row a document: doc_id, class_id (least id of the documents linked to it, directly or over others),
copy_id (its copy class), n_copies (documents in the copy class), n_links (other copy classes at or over the
threshold).

Defined cases: null or empty text has no n-gram, links to nothing and is its own class; a null id cannot be linked:
its row has null class_id and copy_id, and no links; repeated rows (equal id and set) give one row; an id
with several sets gives a row for each, judged as documents of their own; a pair exactly at the threshold is linked, ids play no
part in it; a very long text takes a tile of its own; an empty table gives an empty result; other columns are neither
read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bytetext import Words, mix64, slices, utf8
from .components import components
from .tables import bounded_batches, salted_join, saved, table, text_rows

N, THRESHOLD, RECALL = 5, 0.8, 0.999
MAX_HASHES = 160
TILE, TILE_NGRAMS = 1024, 1 << 20
NO_SET = -(1 << 63)
SKETCH = "doc_id long, k1 long, k2 long, n long, bands array<long>"

_rng = np.random.default_rng(271828)
FACTORS = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, 1024, dtype=np.uint64)


def banding(threshold: float, recall: float = RECALL, hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands find a pair at the threshold with chance ``recall`` within ``hashes`` hashes."""
    best = None
    for rows in range(1, 65):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows <= hashes or best is None:
            best = (bands, rows)
    if best[0] * best[1] > len(FACTORS):
        raise ValueError(f"no banding of {len(FACTORS)} hashes has recall {recall} at {threshold}")
    return best


def ngram_lists(w: Words, n: int) -> list[np.ndarray]:
    """The n-gram hashes of each document of a slice, repeats included."""
    h, out = w.windows(n), []
    for a, b in zip(w.doc[:-1].tolist(), w.doc[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(h[a : b - n + 1])
        elif b > a:
            short = np.uint64(b - a)
            for x in w.hash[a:b]:
                short = (short * np.uint64(0x9E3779B97F4A7C15) + x) & np.uint64(0xFFFFFFFFFFFFFFFF)
            out.append(mix64(np.array([short], np.uint64)))
        else:
            out.append(h[:0])
    return out


def text_set(text: str | bytes | None, n: int = N) -> np.ndarray:
    """The sorted distinct n-gram hashes of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass") if not isinstance(text, bytes) else text
    w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
    with np.errstate(over="ignore"):
        return np.unique(ngram_lists(w, n)[0])


def set_key(u: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of distinct n-grams."""
    return int(mix64(u).sum(dtype=np.uint64)) - (1 << 63), int(mix64(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) - (1 << 63)


def sketches(docs: DataFrame, n: int, doc_id: str, text: str, n_bands: int, n_rows: int) -> DataFrame:
    """The set's 128-bit key, its size and its band hashes, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            k1, k2, size, bands = [], [], [], []
            for i, j in slices(offsets):
                lists = ngram_lists(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), n)
                for h in lists:
                    u = np.unique(h)
                    a, b = set_key(u)
                    k1.append(a)
                    k2.append(b)
                    size.append(len(u))
                counts = np.array([len(h) for h in lists])
                full = np.flatnonzero(counts)
                sign = np.zeros((len(lists), n_bands), np.uint64)
                if len(full):
                    h = np.concatenate([lists[d] for d in full])
                    first = np.concatenate([[0], np.cumsum(counts[full])])[:-1]
                    for b in range(n_bands):
                        own = np.full(len(full), b + 1, np.uint64)
                        for r in range(b * n_rows, (b + 1) * n_rows):
                            own = mix64(own * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h * FACTORS[r] + SHIFTS[r], first))
                        sign[full, b] = own
                bands.extend(sign[d].view(np.int64).tolist() if counts[d] else [] for d in range(len(lists)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "n", "bands"]
            )

    return text_rows(docs, doc_id, text).mapInArrow(run, SKETCH)


def keyed(docs: DataFrame, n: int, text: str, once: str | None = None) -> DataFrame:
    """The rows with the key of their text's set (__k1, __k2); with ``once`` (a column of ids) a task gives an id's set once."""
    where, ids = docs.columns.index(text), docs.columns.index(once) if once else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        seen: set[tuple] = set()  # no longer than a task's rows
        for batch in batches:
            data, offsets = utf8(batch.column(where))
            keys = []
            for i, j in slices(offsets):
                keys.extend(set_key(np.unique(h)) for h in ngram_lists(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), n))
            out = batch.append_column("__k1", pa.array([k for k, _ in keys], pa.int64())).append_column("__k2", pa.array([k for _, k in keys], pa.int64()))
            if once:
                fresh = [not (name in seen or seen.add(name)) for name in zip(batch.column(ids).to_pylist(), keys, strict=True)]
                out = out if all(fresh) else out.filter(pa.array(fresh))
            yield out

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__k1", LongType()), StructField("__k2", LongType())]))


def linked(x: list[np.ndarray], y: list[np.ndarray] | None, threshold: float, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i in x, j in y) at or over the threshold; with y None, pairs i < j in x."""
    both = x if y is None else x + y
    sizes = np.array([len(s) for s in both], np.int64)
    if not len(both):
        return
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), sizes)
    _, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[back] > 1
    number = np.cumsum(count > 1) - 1
    column, owner = number[back[keep]], owner[keep]
    first = np.searchsorted(owner, np.arange(len(both) + 1))
    width = int(number[-1]) + 1 if len(number) else 0
    strip = max(1024, (1 << 23) // max(1, 2 * block))  # columns of a product at a time: bounded memory

    def rows(a: int, b: int, lo: int, hi: int) -> np.ndarray:
        own, col = owner[first[a] : first[b]] - a, column[first[a] : first[b]]
        use = (col >= lo) & (col < hi)
        m = np.zeros((b - a, hi - lo), np.float32)
        m[own[use], col[use] - lo] = 1
        return m

    start = 0 if y is None else len(x)
    for a in range(0, len(x), block):
        a2 = min(a + block, len(x))
        for b in range(a if y is None else start, len(both), block):
            b2 = min(b + block, len(both))
            shared = np.zeros((a2 - a, b2 - b), np.float32)
            for lo in range(0, width, strip):
                hi = min(lo + strip, width)
                left = rows(a, a2, lo, hi)
                shared += left @ (left if b == a and y is None else rows(b, b2, lo, hi)).T
            union = sizes[a:a2, None] + sizes[None, b:b2] - shared
            near = (shared >= threshold * union - 1e-6) & (shared > 0)
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            if y is None:
                use = i < j
                i, j = i[use], j[use]
            yield i, j - start


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each index's component (label passing with pointer jumping)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(docs: DataFrame, n: int, threshold: float, recall: float, doc_id: str, text: str) -> DataFrame:
    """doc_id, k1, k2, class_id, copy_id, n_copies, n_links and ``first`` (stands for its class) of every (doc_id, set)."""
    sketch = saved(sketches(docs, n, doc_id, text, *banding(threshold, recall)), "sketches")
    named = sketch.where("doc_id is not null and n > 0")
    # a copy class is named by its least id and its key: an id with several texts is in several classes
    reps = named.groupBy("k1", "k2").agg(F.min("doc_id").alias("copy_id"), F.count_distinct("doc_id").alias("n_copies"), F.count("*").alias("n_rows"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = saved(reps.withColumn("node", F.struct(F.col("copy_id").alias("id"), "k1", "k2")), "copy-classes")
    members = _groups(reps)
    texts = keyed(text_rows(docs, doc_id, text).where("doc_id is not null"), n, "text", "doc_id").select(F.struct(F.col("doc_id").alias("id"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2")).alias("node"), "text")
    # repeated rows are one a task when they are read, and one in all when they meet their groups
    met = texts.join(members, "node").dropDuplicates(["node"]).withColumn("at", F.explode("at"))
    # each pair of tiles of a group is a task's group
    met = met.select("node.*", "text", "bands", "kept", F.col("at.gid").alias("gid"), F.col("at.tile").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("at.tiles") - 1)).alias("other"))
    met = met.withColumn("p", F.least("tile", "other")).withColumn("q", F.greatest("tile", "other")).drop("other")

    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        np.seterr(over="ignore")
        gid, p, q = key
        rows = rows.sort_values(["id", "k1", "k2"], ignore_index=True)  # so a root is the least node
        first, size = (rows["tile"] == p).to_numpy(), len(rows)
        sets, bands = [text_set(t, n) for t in rows["text"]], np.stack(rows["bands"].to_numpy())
        kept = np.stack(rows["kept"].to_numpy())
        left = np.flatnonzero(first)
        right = None if p == q else np.flatnonzero(~first)
        counts, roots = np.zeros(size, np.int64), np.arange(size)
        for i, j in linked([sets[k] for k in left], None if right is None else [sets[k] for k in right], threshold):
            i, j = left[i], left[j] if right is None else right[j]
            for a in range(0, len(i), 1 << 16):
                x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
                same = bands[x] == bands[y]
                band = same.argmax(axis=1)  # a pair counts in the group of the first band it shares
                own = same[np.arange(len(x)), band] & (kept[x, band] == gid)
                x, y = x[own], y[own]
                counts += np.bincount(x, minlength=size) + np.bincount(y, minlength=size)
                roots = _roots(size, np.concatenate([roots, x]), np.concatenate([np.arange(size), y]))
        keep = np.flatnonzero(counts > 0)
        names = rows[["id", "k1", "k2"]]
        return pd.concat([names.iloc[keep].reset_index(drop=True), names.iloc[roots[keep]].add_prefix("r_").reset_index(drop=True)], axis=1).assign(links=counts[keep])

    found = met.groupBy("gid", "p", "q").applyInPandas(group, "id long, k1 long, k2 long, r_id long, r_k1 long, r_k2 long, links long")
    found = saved(found.select(F.struct("id", "k1", "k2").alias("node"), F.struct(F.col("r_id").alias("id"), F.col("r_k1").alias("k1"), F.col("r_k2").alias("k2")).alias("root"), "links"), "links")
    classes = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    known = reps.select("node", "copy_id", "n_copies", "n_rows").join(links, "node", "left").join(classes, "node", "left")
    known = saved(known.select(F.struct("node.k1", "node.k2").alias("set"), "copy_id", "n_copies", "n_rows", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("component.id"), F.col("copy_id")).alias("class_id"), F.coalesce(F.col("component") == F.col("node"), F.lit(True)).alias("first")), "classes")
    columns = ["doc_id", "k1", "k2", "class_id", "copy_id", "n_copies", "n_links"]
    # copies of one text may be a large part of all rows: their key is salted
    each = salted_join(named.select("doc_id", F.struct("k1", "k2").alias("set")).distinct(), known, "set", "n_rows", sketch.count(), ["doc_id"])
    linkable = each.select("*", "set.*").select(*columns, (F.col("first") & (F.col("doc_id") == F.col("copy_id"))).alias("first"))
    alone = sketch.where("doc_id is null or n = 0").select("doc_id").distinct()
    none, one = F.lit(None).cast("long"), F.lit(1).cast("long")
    return linkable.unionByName(alone.select("doc_id", none.alias("k1"), none.alias("k2"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), one.alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first")))


def _groups(reps: DataFrame) -> DataFrame:
    """node, bands, kept (the group that each band's pairs count in) and at (gid, tile and tiles of the groups it is in)."""
    held = reps.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    # buckets of the same members are one: the least names them
    of = held.groupBy("bucket").agg(F.count("*").alias("m"), F.min("node").alias("head"), F.sum(F.xxhash64("node") % (1 << 40)).alias("s1"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("s2")).where("m > 1")
    of = saved(of, "buckets")
    same = of.groupBy("m", "s1", "s2").agg(F.min("bucket").alias("kept"), F.first("head").alias("head"))
    held = saved(salted_join(held, of.select("bucket", "m", "head", "s1", "s2").join(same.drop("head"), ["m", "s1", "s2"]), "bucket", "m", held.count(), ["node"]).select("node", "n", "band", "kept", "head"), "bucket-members")
    whole = saved(components(held.where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))), "candidates")
    # the cheaper way for each component: all its pairs once, or the pairs of each of its buckets
    in_buckets = same.join(whole.withColumnRenamed("node", "head"), "head").groupBy("component").agg(F.sum(F.col("m") * F.col("m").cast("double")).alias("by_bucket"))
    in_whole = whole.groupBy("component").agg(F.count("*").alias("m")).join(in_buckets, "component")
    way = in_whole.select("component", "m", (F.col("m") * F.col("m").cast("double") > F.col("by_bucket")).alias("split"))
    placed = saved(salted_join(whole, way, "component", "m", reps.count(), ["node"]).select("node", F.when(~F.col("split"), F.xxhash64("component")).alias("joint")), "ways")
    member = held.join(placed, "node").select("node", "n", "band", F.coalesce("joint", "kept").alias("gid"))
    member = saved(member, "band-groups")
    size = member.select("gid", "node", "n").distinct().groupBy("gid").agg(F.count("*").alias("m"), F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(TILE)), F.ceil(F.sum("n") / F.lit(TILE_NGRAMS))).cast("int").alias("tiles"))
    at = salted_join(member.select("gid", "node").distinct(), size, "gid", "m", reps.count(), ["node"])
    at = at.groupBy("node").agg(F.collect_list(F.struct("gid", F.pmod(F.xxhash64("node", "gid"), F.col("tiles")).cast("int").alias("tile"), "tiles")).alias("at"))  # at most a band's number of entries
    kept = member.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("band", "gid"))).alias("kept"))
    out = at.join(kept, "node").join(reps.select("node", "bands"), "node")
    return saved(out.select("node", "bands", F.transform("bands", lambda _, i: F.coalesce(F.element_at("kept", i), F.lit(0))).alias("kept"), "at"), "members")


def near_links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, copy_id, n_copies, n_links of every document."""
    return _links(docs, n, threshold, recall, doc_id, text).select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def without_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, of its least id (and least key, if that id has several texts of the class); rows without an
    id or without words are kept; repeated rows (equal id and set) are kept once."""
    drop = _links(docs, n, threshold, recall, doc_id, text).where(~F.col("first")).select(F.col("doc_id").alias("__dropped"), F.col("k1").alias("__d1"), F.col("k2").alias("__d2"))
    own = (F.col(f"`{doc_id}`").cast("long") == F.col("__dropped")) & (F.col("__k1") == F.col("__d1")) & (F.col("__k2") == F.col("__d2"))
    kept = keyed(docs, n, text).join(drop, own, "left_anti")
    apart = F.col(f"`{doc_id}`").isNull() | ((F.col("__k1") == NO_SET) & (F.col("__k2") == NO_SET))
    row = F.when(apart, F.monotonically_increasing_id()).otherwise(-1)
    return kept.withColumn("__row", row).dropDuplicates([doc_id, "__k1", "__k2", "__row"]).drop("__k1", "__k2", "__row")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(table(spark, sf_dir, "documents"))
