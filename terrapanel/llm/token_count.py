"""Token counts under a unigram vocabulary by trie-shared dynamic programming.

A text is cut at white space; a word (pre-token) is spelt as the marker U+2581 and its characters.  Its best
segmentation is the sequence of vocabulary pieces with the highest total score (ties: fewer pieces, then the longer last
piece); a character that no piece covers costs ``UNKNOWN`` and counts as its UTF-8 bytes.

1. Distinct words of all documents are counted (each task sends a word once a batch of counts).
2. A piece's score is the log of its share, one added, of all pieces into which the vocabulary file's own segmentation cuts
   those words: a unigram model over the given pieces, counted on the whole corpus.  The inventory stays as it is.
3. Words that make up a ``SHARED``-th of all words or more (so at most ``SHARED``) are dealt by ranges of the alphabet, so
   that words with a common beginning meet; each task inserts its range in a trie.  A node holds the forward score and
   piece count of its prefix, which depend on the prefix alone, so they are worked out once however many words share it;
   the node where a word ends gives its terminal count.  The terminal counts are broadcast.
4. Documents are summed where they are read.  Rarer words go into the worker's own trie, which is emptied at ``MAX_NODES``
   nodes.  A word over ``MAX_WORD`` characters is walked with the last few forward scores only and is never stored (for
   step 2 it counts as runs of that length), so no word takes memory beyond its own text.

Defined cases: null or empty text has 0 tokens; ids, null ones too, are carried through row by row; repeated rows are
counted each; equal scores are broken as above; an empty table gives an empty result; other columns are neither read nor
returned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import saved, table, text_rows

MARK = "▁"
UNKNOWN = -25.0
SHARED = 1_500_000
MAX_NODES, MAX_WORD, MAX_COUNTED = 600_000, 256, 200_000
SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class ForwardTrie:
    """Prefixes with forward scores; node 0 is the empty prefix."""

    def __init__(self, pieces: dict[str, float], max_nodes: int = MAX_NODES, max_word: int = MAX_WORD):
        self.pieces, self.max_nodes, self.max_word = pieces, max_nodes, max_word
        self.longest = max(map(len, pieces), default=1)
        ends: dict[str, set[int]] = {}
        for p in pieces:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {e: sorted(n, reverse=True) for e, n in ends.items()}  # of the pieces that end so, longest first
        self.clear()

    def clear(self) -> None:
        self.edges: dict[tuple[int, str], int] = {}
        self.score, self.count, self.unknown = [0.0], [0], [0]
        self.terminal: dict[str, tuple[int, int]] = {}

    def insert(self, word: str) -> tuple[int, int]:
        """(tokens, unknown characters) of the word, marker included."""
        if len(self.score) > self.max_nodes:
            self.clear()
        edges, score, count, unknown, pieces, lengths = self.edges, self.score, self.count, self.unknown, self.pieces, self.lengths
        node, path = 0, [0]
        for i, ch in enumerate(word, 1):
            key = (node, ch)
            last, node = node, edges.get(key)
            if node is None:
                best, before, n = score[last] + UNKNOWN, -1, count[last] + len(ch.encode("utf-8", "surrogatepass"))
                for size in lengths.get(word[i - 2 : i], ()) if i > 1 else ():
                    if size <= i:
                        s = pieces.get(word[i - size : i])
                        if s is not None:
                            p = path[i - size]
                            s += score[p]
                            if s > best or (s == best and count[p] + 1 < n):
                                best, before, n = s, p, count[p] + 1
                s = pieces.get(ch)
                if s is not None:
                    s += score[last]
                    if s > best or (s == best and count[last] + 1 < n):
                        best, before, n = s, last, count[last] + 1
                node = edges[key] = len(score)
                score.append(best)
                count.append(n)
                unknown.append(unknown[last] + 1 if before < 0 else unknown[before])
            path.append(node)
        return count[node], unknown[node]

    def walk(self, word: str) -> tuple[int, int]:
        """The same for a long word: only the last forward scores (score, tokens, unknown) are held."""
        at, pieces, low = [(0.0, 0, 0)], self.pieces, 0
        for i, ch in enumerate(word, 1):
            s, n, u = at[-1]
            best, n, u = s + UNKNOWN, n + len(ch.encode("utf-8", "surrogatepass")), u + 1
            for size in [*(self.lengths.get(word[i - 2 : i], ()) if i > 1 else ()), 1]:
                s = pieces.get(word[i - size : i]) if size <= i else None
                if s is not None:
                    before = at[i - size - low]
                    s += before[0]
                    if s > best or (s == best and before[1] + 1 < n):
                        best, n, u = s, before[1] + 1, before[2]
            at.append((best, n, u))
            if len(at) > 2 * self.longest:
                low += len(at) - self.longest
                del at[: -self.longest]
        return at[-1][1:]

    def tokens(self, word: str) -> tuple[int, int]:
        if len(word) > self.max_word:
            return self.walk(MARK + word)
        found = self.terminal.get(word)
        if found is None:
            found = self.insert(MARK + word)
            self.terminal[word] = found
        return found


class Unigram:
    """Piece scores and the terminal counts of frequent words; a worker adds its trie."""

    def __init__(self, pieces: dict[str, float], terminal: dict[str, tuple[int, int]]):
        self.pieces, self.terminal, self.trie = pieces, terminal, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"trie": None}

    def count(self, text: str | None) -> tuple[int, int, int]:
        """(words, tokens, unknown characters) of a text."""
        trie = self.trie = self.trie or ForwardTrie(self.pieces)
        words, shared, own, n, u = (text or "").split(), self.terminal, trie.terminal, 0, 0
        for w in words:
            found = shared.get(w) or own.get(w)
            if found is None:
                found = trie.tokens(w)
                own = trie.terminal
            n += found[0]
            u += found[1]
        return len(words), n, u


def distinct_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: how often it stands in all texts; words over MAX_WORD characters as runs of that length."""

    def sent(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column(1):
                words = (value.as_py() or "").split()
                if words and len(max(words, key=len)) > MAX_WORD:
                    words = [w[a : a + MAX_WORD] for w in words for a in range(0, len(w), MAX_WORD)]
                counts.update(words)
                if len(counts) > MAX_COUNTED:
                    yield sent(counts)
                    counts.clear()
        yield sent(counts)

    return text_rows(docs, doc_id, text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_scores(words: DataFrame, path: str) -> dict[str, float]:
    """Log shares of the ordinary pieces in the file's segmentation of the counted words, one added to each."""
    sp = processor(path)
    ordinary = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    size = sp.get_piece_size()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = processor(path), np.zeros(size, np.int64)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for a in range(0, len(words), 10_000):
                lists = own.encode(words[a : a + 10_000], num_threads=1)
                ids = np.fromiter((x for t in lists for x in t), np.int64)
                np.add.at(total, ids, np.repeat(n[a : a + 10_000], [len(t) for t in lists]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    found = {r["id"]: r["n"] for r in words.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}  # a row a piece
    total = sum(found.get(i, 0) + 1 for i in ordinary)
    return {sp.id_to_piece(i): math.log((found.get(i, 0) + 1) / total) for i in ordinary}


def fit(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", shared: int = SHARED) -> Broadcast:
    """The broadcast scores and terminal counts (at most ``shared`` words of at most MAX_WORD characters)."""
    spark, words = docs.sparkSession, saved(distinct_words(docs, doc_id, text), "words")
    pieces = piece_scores(words, path or vocabulary_path())
    total = words.agg(F.sum("n")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ForwardTrie(pieces)
        for batch in batches:
            found = [trie.tokens(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))], ["word", "tokens", "unknown"])

    often = words.where(F.col("n") * shared >= total).select("word")
    ranged = often.repartitionByRange(max(1, 2 * spark.sparkContext.defaultParallelism), "word").sortWithinPartitions("word")
    rows = ranged.mapInArrow(run, "word string, tokens long, unknown long").collect()
    return spark.sparkContext.broadcast(Unigram(pieces, {r["word"]: (r["tokens"], r["unknown"]) for r in rows}))


def count_tokens(docs: DataFrame, model: Broadcast, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown (characters spelt as bytes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            rows = [own.count(value.as_py()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return text_rows(docs, doc_id, text).mapInArrow(run, SCHEMA)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, fit(docs))
