"""Benchmark decontamination: word windows of benchmark items looked up in training documents.

Items are lower-cased (A-Z) and cut into words; every window of ``n`` consecutive words of an item is kept (an
item of fewer words, but not none, is one window).  Where the items have at most ``max_windows`` windows (a bound taken
from their lengths before anything is collected), the windows form a hash set that is broadcast, and a document
position whose window hash is in the set is verified word by word.

A larger benchmark is never collected: its windows stay a table, and only a bitmap of ``BITS`` hash prefixes is
broadcast, whose size does not depend on the benchmark.  Positions that pass it are written once and meet the windows
by an equi-join on hash, length and words; keys that many positions share are salted.  Both ways give the same rows.

Defined cases: null or empty text has no words, no hits and is not contaminated; null document ids are carried
through; windows of items with a null id count as any others, such items together are one of ``n_items`` and have
no name in ``items_sha256``; repeated document rows are judged one by one; repeated item ids count once; empty tables give empty results or
clean documents; columns other than the named ones are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import Words, slices, utf8
from .tables import bounded_batches, salted_join, saved, table, text_rows

WINDOW = 13
MAX_WINDOWS = 2_000_000
BITS = 27  # of the bitmap of window hashes: 16 MB
SPAN_NAMES = ["doc_id", "n_words", "hit_from", "hit_to", "items"]
SPANS = "doc_id long, n_words long, hit_from array<int>, hit_to array<int>, items array<long>"


def _nulls_last(item: int | None) -> tuple[bool, int]:
    return item is None, item or 0


class WindowSet:
    """Windows of benchmark items: per length a sorted hash array, with the words for verification."""

    def __init__(self, items: list[tuple[int | None, str]], n: int):
        self.n = n
        found: dict[int, dict[bytes, set[int | None]]] = {}
        for item, text in items:
            data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            w = Words(data, np.array([0, len(data)], np.int64))
            words = [w.low[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
            k = min(n, len(words))
            for i in range(len(words) - k + 1 if k else 0):
                found.setdefault(k, {}).setdefault(b" ".join(words[i : i + k]), set()).add(item)
        self.by_length = []
        for k, windows in sorted(found.items()):
            joined = list(windows)
            data = np.frombuffer(b"\n".join(joined), np.uint8)
            # words of all windows in one buffer: window i takes the words i*k .. i*k+k-1
            w = Words(data, np.array([0, len(data)], np.int64))
            hashes = w.windows(k)[::k]
            order = np.argsort(hashes, kind="stable")
            self.by_length.append((k, hashes[order], [joined[i] for i in order], [sorted(windows[joined[i]], key=_nulls_last) for i in order]))

    def hits(self, w: Words) -> Iterator[tuple[int, int, list[int]]]:
        """Verified (first word, length, items) in word order for each length."""
        for k, hashes, texts, items in self.by_length:
            at = w.windows(k)
            if not len(at):
                continue
            probe = np.searchsorted(hashes, at)
            probe[probe == len(hashes)] = 0
            for i in np.flatnonzero(hashes[probe] == at).tolist():
                d = int(np.searchsorted(w.doc, i, "right")) - 1
                if i + k > w.doc[d + 1]:
                    continue
                text = b" ".join(w.low[w.start[j] : w.end[j]].tobytes() for j in range(i, i + k))
                p = int(probe[i])
                while p < len(hashes) and hashes[p] == at[i]:
                    if texts[p] == text:
                        yield i, k, items[p]
                        break
                    p += 1


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Unite overlapping or touching [from, to) ranges."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def scan(docs: DataFrame, windows, doc_id: str, text: str) -> DataFrame:
    """One row per document: its words and the word ranges hit by the broadcast windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows.value
        for batch in batches:
            ids, (data, offsets) = batch.column(0), utf8(batch.column(1))
            n_words, hit_from, hit_to, items = [], [], [], []
            for i, j in slices(offsets):
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                per: dict[int, tuple[list, set]] = {}
                for first, k, own in known.hits(w):
                    d = int(np.searchsorted(w.doc, first, "right")) - 1
                    spans, got = per.setdefault(d, ([], set()))
                    spans.append((first - int(w.doc[d]), first - int(w.doc[d]) + k))
                    got.update(own)
                n_words.append(np.diff(w.doc))
                for d in range(j - i):
                    spans, got = per.get(d, ((), ()))
                    joined = merged(spans)
                    hit_from.append([a for a, _ in joined])
                    hit_to.append([b for _, b in joined])
                    items.append(sorted(got, key=_nulls_last))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array(hit_from, pa.list_(pa.int32())), pa.array(hit_to, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))],
                SPAN_NAMES,
            )

    return text_rows(docs, doc_id, text).mapInArrow(run, SPANS)


def hit_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_windows: int = MAX_WINDOWS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, hit_from[], hit_to[] (word ranges, merged) and items[] for each document row."""
    items = _items(benchmark, item_id, item_text)
    if _bound(items) <= max_windows:
        return scan(docs, docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in items.collect()], n)), doc_id, text)
    return _met(text_rows(docs, doc_id, text), items, n).drop("row")


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))


def _bound(items: DataFrame) -> float:
    """At least the number of windows: an item has at most as many as words, and at most one word for two characters."""
    return items.agg(F.sum(F.length("text") / 2 + 1).alias("n")).first()["n"] or 0


def _windows(items: DataFrame, n: int) -> DataFrame:
    """hash, k, words, item of every distinct window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = np.diff(w.doc)
                for k in np.unique(np.minimum(size[size > 0], n)).tolist():
                    at, own = w.windows(k), w.whole(k)[: max(0, len(w) - k + 1)]
                    d = np.searchsorted(w.doc, np.arange(len(at)), "right") - 1
                    at_ = np.flatnonzero(own & (np.minimum(size[d], n) == k))
                    yield _rows(w, at_, k, at).add_column(3, pa.field("item", pa.int64()), batch.column(0).take(pa.array(i + d[at_])).cast(pa.int64()))

    return items.mapInArrow(run, "hash long, k int, words string, item long").distinct()


def _rows(w: Words, at: np.ndarray, k: int, hashes: np.ndarray) -> pa.RecordBatch:
    words = [b" ".join(w.low[w.start[j] : w.end[j]].tobytes() for j in range(i, i + k)) for i in at.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(np.full(len(at), k, np.int32)), pa.array(words, pa.binary()).cast(pa.string())], ["hash", "k", "words"])


def _met(rows: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """As hit_spans for rows of (doc_id, text), with ``row`` (their ``row``, if they have one)."""
    spark = rows.sparkSession
    windows = saved(_windows(items, n), "windows")
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())  # at most n numbers
    word = F.shiftrightunsigned("hash", 64 - BITS)
    bits = windows.groupBy(F.shiftright(word, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITS}) & 63 as int))")).alias("bits")).toArrow()  # at most 2^(BITS - 6) pairs of numbers
    table_ = np.zeros(1 << (BITS - 6), np.uint64)
    table_[bits.column("at").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    known = spark.sparkContext.broadcast(table_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = known.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n_words, found = [], [[] for _ in range(batch.num_rows)]
            for i, j in slices(offsets):
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n_words.append(np.diff(w.doc))
                for k in lengths:
                    h = w.windows(k)
                    p = h >> np.uint64(64 - BITS)
                    at = np.flatnonzero(((bitmap[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool) & w.whole(k)[: len(h)])
                    for place, row in zip(at.tolist(), _rows(w, at, k, h).to_pylist(), strict=True):
                        d = int(np.searchsorted(w.doc, place, "right")) - 1
                        found[i + d].append(row | {"at": place - int(w.doc[d])})
            kind = pa.list_(pa.struct([("hash", pa.int64()), ("k", pa.int32()), ("words", pa.string()), ("at", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array(found, kind), batch.column(2)], ["doc_id", "n_words", "found", "row"])

    if "row" not in rows.columns:
        rows = rows.withColumn("row", F.lit(None).cast("long"))
    scanned = rows.select("doc_id", "text", "row").mapInArrow(run, "doc_id long, n_words long, found array<struct<hash:long,k:int,words:string,at:int>>, row long")
    scanned = saved(scanned.withColumn("row", F.coalesce("row", F.monotonically_increasing_id())), "positions")  # numbers are fixed once written
    places = scanned.select("row", F.inline("found"))
    weights = places.groupBy("hash").agg(F.count("*").alias("m"))
    hits = saved(salted_join(places, windows.withColumnRenamed("k", "wk").withColumnRenamed("words", "wt").join(weights, "hash"), "hash", "m", places.count(), ["row", "at"]).where("k = wk and words = wt").select("row", "at", "k", "item"), "hits")
    spans = hits.select("row", "at", "k").distinct().groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("k")).alias("b")))).alias("spans"))
    named = hits.groupBy("row").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull()).alias("unnamed"))
    out = scanned.drop("found").join(spans.join(named, "row"), "row", "left")
    items_ = F.concat(F.array_sort(F.coalesce("items", F.array().cast("array<long>"))), F.when(F.col("unnamed"), F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<long>")))
    out = out.select("doc_id", "n_words", "spans", items_.alias("items"), "row")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = [merged([(s["a"], s["b"]) for s in own or ()]) for own in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([[r[e] for r in own] for own in joined], pa.list_(pa.int32())) for e in (0, 1)), batch.column(3), batch.column(4)], [*SPAN_NAMES, "row"])

    return out.mapInArrow(unite, SPANS + ", row long")


def judged(spans: DataFrame) -> DataFrame:
    """The digest columns of the contract: contaminated if words are hit and they are at least a twentieth of all."""
    n_hit = F.aggregate(F.arrays_zip("hit_from", "hit_to"), F.lit(0).cast("long"), lambda acc, x: acc + (x["hit_to"] - x["hit_from"]))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return spans.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def remove_spans(text: str | None, hit_from: list[int], hit_to: list[int]) -> str | None:
    """The text without the hit word ranges (from the first word's first byte to the last word's last byte)."""
    if not text or not hit_from:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
    out, at = [], 0
    for a, b in zip(hit_from, hit_to, strict=True):
        out.append(raw[at : int(w.start[a])])
        at = int(w.end[b - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = WINDOW, max_windows: int = MAX_WINDOWS, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without contaminated ones (mode "documents") or with hit spans cut out (mode "spans").

    Returns the columns of ``docs``.  Within the broadcast bound each batch is judged and its rows are kept or rewritten in
    place, so nothing is shuffled.  Beyond it the rows are numbered and written, and their spans joined back by number.
    """
    items = _items(benchmark, item_id, item_text)
    if _bound(items) > max_windows:
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
        held = saved(docs.select(row, F.monotonically_increasing_id().alias("row")), "numbered")
        own = F.col("doc").getField(text).cast("string")
        found = _met(held.select(F.lit(None).cast("long").alias("doc_id"), own.alias("text"), "row"), items, n)
        met = held.join(found.select("row", "n_words", "hit_from", "hit_to"), "row")
        if mode == "documents":
            n_hit = F.aggregate(F.arrays_zip("hit_from", "hit_to"), F.lit(0).cast("long"), lambda acc, x: acc + (x["hit_to"] - x["hit_from"]))
            return met.where((n_hit == 0) | (n_hit * 20 < F.col("n_words"))).select("doc.*")
        kept = met.select("doc.*", F.col("hit_from").alias("__from"), F.col("hit_to").alias("__to"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                where = batch.schema.names.index(text)
                texts = [remove_spans(t, x, y) for t, x, y in zip(batch.column(where).to_pylist(), a, b, strict=True)]
                batch = batch.set_column(where, batch.schema.field(where), pa.array(texts, batch.schema.field(where).type))
                yield batch.select(list(range(batch.num_columns - 2)))

        return kept.mapInArrow(cut, docs.schema)
    known = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in items.collect()], n))
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(where))
            keep, texts = np.ones(batch.num_rows, bool), {}
            for i, j in slices(offsets):
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                per: dict[int, list] = {}
                for first, k, _ in known.value.hits(w):
                    d = int(np.searchsorted(w.doc, first, "right")) - 1
                    per.setdefault(d, []).append((first - int(w.doc[d]), first - int(w.doc[d]) + k))
                for d, spans in per.items():
                    joined = merged(spans)
                    if mode == "spans":
                        texts[i + d] = remove_spans(batch.column(where)[i + d].as_py(), [a for a, _ in joined], [b for _, b in joined])
                    else:
                        keep[i + d] = 20 * sum(b - a for a, b in joined) < w.doc[d + 1] - w.doc[d]
            if texts:
                column = batch.column(where).to_pylist()
                for d, t in texts.items():
                    column[d] = t
                batch = batch.set_column(where, batch.schema.field(where), pa.array(column, batch.schema.field(where).type))
            yield batch.filter(pa.array(keep))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(hit_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
places AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hits AS (SELECT a.doc_id, a.i, a.k, b.item_id FROM places a JOIN win b USING (k, t)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n, 0) AS BIGINT) AS n_items,
 sha256(coalesce(s.t, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN its s USING (doc_id)
"""
