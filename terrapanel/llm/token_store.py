"""Token ids in a content-addressed store: rolling-hash chunks, recipes and Merkle manifests.

Writing, one scan and one shuffle: every text is encoded where it is read; a rolling hash over the last ``ROLL`` ids
cuts each document's id stream into chunks of about ``MEAN`` ids (``LEAST`` to ``MOST``), so equal passages give equal
chunks.  A chunk is named by the SHA-256 of its ids; a task sends each chunk of its own once.  The shuffle on the name
brings copies together and one is written.  A document's recipe lists its chunk names; its Merkle root is the
SHA-256 over them.  Recipes are range-partitioned by (doc_id, root), so the store lists documents in ascending
order; a segment root covers the document roots of a partition and the store root the segment roots.

Layout below the store's path: ``data/kind=chunk`` (name, n, payload), ``data/kind=recipe`` (as written),
``recipes`` (in order, with segment and start), ``manifest`` (a row a segment), ``root``.  Payload: the low bytes of all
ids, then the next bytes (2 or 4 planes), zstd-compressed.

Reading: every stored chunk is opened, its name is checked against its ids, and its CRC-32 is taken; recipes meet the
chunks by name; the CRC of a document follows from those of its chunks (CRC combination); document, segment and store roots, counts
and starts are recomputed and compared with the manifest and ``root``.

Texts are cut where the byte-level vocabulary surely begins a new pre-token, and a byte-level BPE never merges across these:
before a space that a solid character follows, before and after other ASCII white space that one follows, and between an
ASCII letter and ASCII punctuation or white space (a text that holds a special token's string is not cut).  Each distinct piece of a slice
is encoded once by the tokenizers library (its own pre-tokeniser, merges and special tokens); a worker remembers short
pieces.  Where a boundary is not sure there is no cut, which only makes a piece longer.

Defined cases: null or empty text is the end id alone; null ids come last; rows with one doc_id are ordered
by their Merkle root and each has its own start; an empty table gives an empty store; other columns are neither
read nor returned.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytetext import _BASE, BYTE_KEYS, mix64, powers, slices, spread, utf8
from .tables import salted_join, saved, scratch, table, text_rows

END_ID = 2
ROLL, LEAST, MEAN, MOST = 8, 64, 1024, 8192
ENCODE_SLICE = 1 << 20
SEGMENT_DOCS = 100_000
ROW = "key string, kind string, n long, payload binary, doc_id long, n_chunks int, names binary, row long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- encoding

#: Bytes that surely begin no white space: printable ASCII and all lead bytes but those of U+0085, U+00A0, U+1680, U+2000-U+205F and U+3000.
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = True
SOLID[0xC3:0xF5] = True
SOLID[[0xE1, 0xE2, 0xE3]] = False
LETTER, BREAK, ENDS = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
BREAK[9:14] = True  # ASCII white space but the space
ENDS[0x21:0x30] = ENDS[0x3A:0x41] = ENDS[0x5B:0x61] = ENDS[0x7B:0x7F] = ENDS[9:14] = True  # ends a run of letters


class Encoder:
    """Ids of many texts with the tokenizers library, each distinct piece once."""

    MAX_KNOWN, MAX_IDS, SHORT = 1_500_000, 1 << 24, 64

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.levels = [self._level(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    @staticmethod
    def _level(h: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple:
        order = np.argsort(h, kind="stable")
        return h[order], at[order], size[order]

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, size, found = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        for keys, a, s in self.levels:
            if len(keys):
                p = np.searchsorted(keys, h)
                p[p == len(keys)] = 0
                hit = keys[p] == h
                at[hit], size[hit], found[hit] = a[p[hit]], s[p[hit]], True
        return at, size, found

    def _learn(self, h: np.ndarray, lists: list[list[int]]) -> None:
        size = np.array([len(t) for t in lists], np.int64)
        new = np.fromiter((x for t in lists for x in t), np.uint32, int(size.sum()))
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used : self.used + len(new)] = new
        at = self.used + np.cumsum(size) - size
        self.used += len(new)
        small = self._level(*(np.concatenate([a, b]) for a, b in zip(self.levels[1], (h, at, size), strict=True)))
        if len(small[0]) > 20_000 + len(self.levels[0][0]) // 3:
            big = self._level(*(np.concatenate([a, b]) for a, b in zip(self.levels[0], small, strict=True)))
            self.levels = [big, self._level(*(x[:0] for x in small))]
        else:
            self.levels = [self.levels[0], small]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, each closed by END_ID; offsets of the documents in them)."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        solid = SOLID[data[1:]]
        edge = offsets[(offsets > 0) & (offsets < n)]
        solid[edge - 1] = False  # the next document's
        cut[: max(0, n - 1)] = (data[:-1] == 0x20) & solid
        last = BREAK[data[:-1]] & solid  # the last sign of a run of white space stands alone
        cut[1:n] |= last | (LETTER[data[:-1]] & ENDS[data[1:]])
        cut[: max(0, n - 1)] |= last
        raw = data.tobytes()
        for name in self.special:
            p = raw.find(name)
            while p >= 0:
                d = int(np.searchsorted(offsets, p, "right")) - 1
                cut[offsets[d] : offsets[d + 1]] = False  # the whole document is one piece
                p = raw.find(name, int(offsets[d + 1]))
        cut[offsets] = True
        start = np.flatnonzero(cut[:n])
        end = np.append(start[1:], n)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_KEYS[data] * up[:n], out=total[1:])
        h = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)) if n else np.zeros(0, np.uint64)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.levels[0][0]) + len(self.levels[1][0]) > self.MAX_KNOWN or self.used > self.MAX_IDS:
            self.clear()
        where, size, found = self._find(keys)
        held = self.flat
        if not found.all():
            length = end[first] - start[first]
            miss = np.flatnonzero(~found & (length <= self.SHORT))
            long = np.flatnonzero(~found & (length > self.SHORT))
            texts = [raw[start[i] : end[i]].decode("utf-8", "surrogatepass") for i in first[np.concatenate([miss, long])].tolist()]
            lists = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            self._learn(keys[miss], lists[: len(miss)])
            where, size, found = self._find(keys)
            held = self.flat
            if len(long):  # of this slice only
                size[long] = [len(t) for t in lists[len(miss) :]]
                where[long] = self.used + np.cumsum(size[long]) - size[long]
                held = np.concatenate([self.flat[: self.used], np.fromiter((x for t in lists[len(miss) :] for x in t), np.uint32)])
        sizes = size[back]
        ids = held[spread(where[back], sizes)]
        # ids of each document, then the end id
        edge = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(start, offsets)]
        at = edge + np.arange(len(edge))
        out = np.full(at[-1], END_ID, np.uint32)
        body = np.ones(len(out), bool)
        body[at[1:] - 1] = False
        out[body] = ids
        return out, at


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Give a worker's encoders back with the pieces they remember (over 100 MB when full): reading needs none."""
    _encoders.clear()
    pa.default_memory_pool().release_unused()


# ---------------------------------------------------------------- chunks


def cuts(ids: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Chunk edges of every document (first 0, last its length), from a rolling hash of the last ROLL ids."""
    n = len(ids)
    keyed = mix64(ids.astype(np.uint64) + np.uint64(0x51))
    rolled = np.zeros(n, np.uint64)
    if n >= ROLL:
        for i in range(ROLL):
            rolled[ROLL - 1 :] += keyed[ROLL - 1 - i : n - i] * np.uint64(pow(_BASE, i, 1 << 64))
    marks = np.flatnonzero((mix64(rolled) & np.uint64(MEAN - 1)) == 0)
    first = np.searchsorted(marks, offsets)
    out = []
    for d in range(len(offsets) - 1):
        a, b = int(offsets[d]), int(offsets[d + 1])
        edges = [0]
        for m in marks[first[d] : first[d + 1]].tolist():
            m -= a
            if m + 1 < ROLL or m + 1 - edges[-1] < LEAST:
                continue
            while m + 1 - edges[-1] > MOST:
                edges.append(edges[-1] + MOST)
            edges.append(m + 1)
        while b - a - edges[-1] > MOST:
            edges.append(edges[-1] + MOST)
        if edges[-1] < b - a:
            edges.append(b - a)
        out.append(edges)
    return out


def pack(ids: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Byte planes of the ids (the first byte tells how many), zstd-compressed."""
    planes = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    raw = ids.astype("<u2" if planes == 2 else "<u4").view(np.uint8).reshape(-1, planes).T.tobytes()
    return bytes([planes]) + press.compress(raw)


def unpack(payload: bytes, press: zstandard.ZstdDecompressor) -> np.ndarray:
    planes = payload[0]
    raw = np.frombuffer(press.decompress(payload[1:]), np.uint8).reshape(planes, -1).T
    return np.ascontiguousarray(raw).view("<u2" if planes == 2 else "<u4").ravel().astype("<u4")


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of kind chunk (once a task) and recipe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, press, seen = encoder(path), zstandard.ZstdCompressor(level=1), set()
        row = (TaskContext.get().partitionId() + 1) << 33
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            own = batch.column(0).to_pylist()
            for i, j in slices(offsets, ENCODE_SLICE):
                ids, at = enc.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                flat, rows = ids.astype("<u4"), []
                for d, edges in enumerate(cuts(ids, at)):
                    names, base = [], int(at[d])
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        chunk = flat[base + a : base + b]
                        name = hashlib.sha256(chunk.tobytes()).digest()
                        names.append(name)
                        if name not in seen:
                            seen.add(name)
                            rows.append((name.hex(), "chunk", b - a, pack(chunk, press), None, None, None, None))
                    joined = b"".join(names)
                    rows.append((hashlib.sha256(joined).hexdigest(), "recipe", int(at[d + 1] - at[d]), None, own[i + d], len(names), joined, row))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(TYPES)], NAMES)

    return text_rows(docs, doc_id, text).mapInArrow(run, ROW)


NAMES = ["key", "kind", "n", "payload", "doc_id", "n_chunks", "names", "row"]
TYPES = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by kind and key, the first of each chunk and every recipe."""
    last = None
    for batch in batches:
        keep = []
        for kind, key in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
            keep.append(kind == "recipe" or key != last)
            last = key if kind == "chunk" else last
        yield batch.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, store: str, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode the texts and write the store below ``store``."""
    spark, rows = docs.sparkSession, encoded(docs, path or vocabulary_path(), doc_id, text)
    # recipes of repeated rows are alike: they are dealt by row number
    dealt = rows.repartition(F.when(F.col("kind") == "chunk", F.col("key")).otherwise(F.col("row").cast("string")))
    dealt.sortWithinPartitions("kind", "key").mapInArrow(_once, ROW).write.option("compression", "none").partitionBy("kind").parquet(f"{store}/data")
    made = spark.read.schema(ROW).parquet(f"{store}/data").where("kind = 'recipe'").select("doc_id", "n", "n_chunks", "names", F.col("key").alias("root"), "row")
    order = [F.col("doc_id").asc_nulls_last(), F.col("root"), F.col("row")]  # repeated rows may fill many segments
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-made.count() // SEGMENT_DOCS))  # a segment's roots meet in one group
    made.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("segment", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{store}/segments")
    segments = spark.read.parquet(f"{store}/segments")
    manifest = summed(segments)
    before = W.orderBy("segment").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long"))).coalesce(1).write.parquet(f"{store}/manifest")
    spark.createDataFrame([(store_root(spark, store),)], "root string").coalesce(1).write.parquet(f"{store}/root")


def summed(segments: DataFrame) -> DataFrame:
    """segment, documents, ids and root of the recipes as they lie in the store."""
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "root")))
    return segments.groupBy("segment").agg(F.count("*").alias("documents"), F.sum("n").alias("ids"), F.sha2(F.array_join(F.transform(listed, lambda x: x["root"]), ""), 256).alias("root"))


def checked_segments(spark: SparkSession, store: str) -> DataFrame:
    """segment, lost (documents that the manifest lists but the recipes lack) and sound: recipes give the manifest's row again.

    Starts must follow from the ids of earlier segments, and the segment roots must give the written store root; else no segment is sound.
    """
    manifest = spark.read.parquet(f"{store}/manifest")
    kept = spark.read.parquet(f"{store}/root").first()
    rooted = kept is not None and kept["root"] == store_root(spark, store)
    found = summed(spark.read.parquet(f"{store}/segments")).select("segment", *(F.col(c).alias(f"own_{c}") for c in ("documents", "ids", "root")))
    before = W.orderBy("segment").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    placed = manifest.withColumn("own_start", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))
    same = F.lit(rooted)
    for c in ("documents", "ids", "root", "start"):
        same = same & F.col(c).eqNullSafe(F.col(f"own_{c}"))
    lost = F.greatest(F.coalesce("documents", F.lit(0)) - F.coalesce("own_documents", F.lit(0)), F.lit(0))
    return placed.join(found, "segment", "full").select("segment", lost.alias("lost"), same.alias("sound"))


def recipes(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n, n_chunks, names, root, segment in the store's order (start is NULL for a segment that the manifest lacks)."""
    segments, manifest = spark.read.parquet(f"{store}/segments"), spark.read.parquet(f"{store}/manifest")
    w = W.partitionBy("segment").orderBy(F.col("doc_id").asc_nulls_last(), "root", "row").rowsBetween(W.unboundedPreceding, -1)
    first = F.broadcast(manifest.select("segment", F.col("start").alias("first")))  # a row a partition
    return segments.withColumn("within", F.coalesce(F.sum("n").over(w), F.lit(0).cast("long"))).join(first, "segment", "left").select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n", "n_chunks", "names", "root", "segment")


def store_root(spark: SparkSession, store: str) -> str:
    roots = [r["root"] for r in spark.read.parquet(f"{store}/manifest").orderBy("segment").select("root").collect()]
    return hashlib.sha256("".join(roots).encode()).hexdigest()


def with_chunks(listed: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each chunk (seq, key) of the recipes' names, with the chunk's columns; chunks of very many documents are salted."""
    refs = listed.withColumn("names", F.split(F.regexp_replace(F.lower(F.hex("names")), "(.{64})(?=.)", "$1,"), ","))
    refs = refs.select(*(c for c in refs.columns if c != "names"), F.posexplode("names").alias("seq", "key"))
    often = refs.groupBy("key").agg(F.count("*").alias("n_refs"))
    return salted_join(refs, chunks.join(often, "key"), "key", "n_refs", listed.agg(F.sum("n_chunks")).first()[0] or 0, ["start", "seq"], "left")


def read_documents(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, ids of every document, put together from the chunks."""
    chunks = spark.read.schema(ROW).parquet(f"{store}/data").where("kind = 'chunk'").select("key", "payload")

    def run(key, pdf):
        press = zstandard.ZstdDecompressor()
        ids = np.concatenate([unpack(bytes(p), press) for p in pdf.sort_values("seq")["payload"]])
        return pdf.iloc[:1][["doc_id", "start"]].assign(ids=[ids.astype(np.int64)])

    met = with_chunks(recipes(spark, store).select("doc_id", "start", "n_chunks", "names"), chunks)
    return met.select("doc_id", "start", "seq", "payload").groupBy("doc_id", "start").applyInPandas(run, "doc_id long, start long, ids array<long>")


# ---------------------------------------------------------------- reading back


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of CRC-32 polynomials (bit-reversed), element by element."""
    a, b = a.astype(np.uint32), b.astype(np.uint32)
    out = np.zeros(np.broadcast(a, b).shape, np.uint32)
    b = np.broadcast_to(b, out.shape).copy()
    for i in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(i)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(0xEDB88320), b >> np.uint32(1))
    return out


def _shift(n_bytes: np.ndarray) -> np.ndarray:
    """x ** (8 n) modulo the CRC-32 polynomial."""
    out, power, n = np.full(n_bytes.shape, 1 << 31, np.uint32), np.array([1 << 23], np.uint32), n_bytes.astype(np.int64).copy()
    while n.any():
        out = np.where(n & 1, _times(out, power), out)
        power, n = _times(power, power), n >> 1
    return out


def combined_crc(crc: np.ndarray, n_bytes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """CRC-32 of each owner's parts in order; owner is sorted and counts from 0."""
    count = np.bincount(owner) if len(owner) else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    shift, out = _shift(n_bytes), np.zeros(len(count), np.uint32)
    for k in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > k)
        at = first[live] + k
        out[live] = _times(out[live], shift[at]) ^ crc[at].astype(np.uint32)
    return out


def chunk_sums(spark: SparkSession, store: str) -> DataFrame:
    """key, crc of every stored chunk, after its ids are read and checked against its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        forget()
        for batch in batches:
            crc, n = [], []
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = unpack(payload, press).tobytes()
                good = hashlib.sha256(raw).hexdigest() == key
                crc.append(zlib.crc32(raw) if good else None)
                n.append(len(raw) // 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["key", "n", "crc"])

    return spark.read.schema(ROW).parquet(f"{store}/data").where("kind = 'chunk'").select("key", "payload").mapInArrow(run, "key string, n long, crc long")


def verify_store(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks, intact of each document, from the files.

    A document is intact if its chunks, its root, its segment and the store root are.  A segment's documents that the manifest
    counts but no recipe holds give one row with NULL ids and intact false for each.
    """
    checked = saved(checked_segments(spark, store), "checked-segments")
    lost = checked.where("lost > 0").select(F.explode(F.sequence(F.lit(1).cast("long"), "lost")))
    sound = F.broadcast(checked.where("sound").select("segment", "sound"))  # a row a partition
    listed = recipes(spark, store).join(sound, "segment", "left").withColumn("sound", F.coalesce("sound", F.lit(False)))
    met = with_chunks(listed.select("doc_id", "start", F.col("n").alias("n_tokens"), "n_chunks", "root", "sound", "names"), saved(chunk_sums(spark, store), "chunk-sums"))
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("crc", F.lit(-1)).alias("crc"), "key")))
    per = met.groupBy("doc_id", "start", "n_tokens", "n_chunks", "root", "sound").agg(parts.alias("parts"))
    root = F.sha2(F.unhex(F.array_join(F.col("parts.key"), "")), 256)
    per = per.select("doc_id", "start", "n_tokens", "n_chunks", ((root == F.col("root")) & F.col("sound")).alias("rooted"), F.col("parts.n").alias("n"), F.col("parts.crc").alias("crc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crc = batch.column(5), batch.column(6)
            counts = np.diff(n.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), counts)
            sizes, sums = n.flatten().to_numpy(), crc.flatten().to_numpy()
            ids = np.bincount(owner, sizes, batch.num_rows).astype(np.int64)
            whole = np.bincount(owner, sums < 0, batch.num_rows) == 0
            intact = whole & batch.column(4).to_numpy(zero_copy_only=False).astype(bool) & (ids == batch.column(2).to_numpy())
            out = combined_crc(np.maximum(sums, 0), sizes * 4, owner).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(out), batch.column(3), pa.array(intact)], ["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "intact"])

    kinds = {"doc_id": "long", "start": "long", "n_tokens": "long", "ids_crc32": "long", "n_chunks": "int"}
    absent = lost.select(*(F.lit(None).cast(t).alias(c) for c, t in kinds.items()), F.lit(False).alias("intact"))
    return per.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks int, intact boolean").unionByName(absent)


def store_and_verify(docs: DataFrame, path: str | None = None, **names) -> DataFrame:
    """Write a new store in the shared folder, read it back, and return a row a document."""
    spark = docs.sparkSession
    store = scratch(spark, "token-store")
    write_store(docs, store, path, **names)
    return verify_store(spark, store)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_verify(table(spark, sf_dir, "documents"))
