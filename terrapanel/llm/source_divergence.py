"""How far the sources of a language lie apart in their words, and which words set a source off from its language.

Tasks read whole texts as UTF-8 buffers: a lookup table lower-cases A-Z and finds the edges of terms (runs of letters and of
bytes from 0x80 on), xxhash groups the slices, and each is compared with its group's first by its bytes.  Counts are
summed in the worker before they are shuffled once, by language and term; there a term's documents are added up and terms
in fewer than ``MIN_DOCS`` documents of the language go.

The counts that stay are dealt into blocks of terms of about ``BLOCK_ROWS`` entries.  A block is a matrix in compressed
sparse rows, a row a source: every source's line is laid out once, and the differences to all others are sums over the
rows (``reduceat``), where terms that neither source uses come in by their number.  A block gives one partial sum a pair of
sources and the ``TOP`` first terms of each source; partial sums are added by pair.  All numbers are integers: shares are
floor(SCALE * (count + 5) / (total + 5 V)), by long division in 64 bits, exact for totals up to 2**63 / 1000.

Memory of a task grows with its block and the number of a language's sources, not with the corpus.  The result has a row
for each ordered pair of sources of a language, as the audit asks for all of them.

Defined cases: null text, language or source counts as ''; a source without terms is compared by the terms of its
language; a language without kept terms has pairs of value 0; repeated rows are documents each; ties go to the lesser item
by UTF-8; very long texts are slices of their own; an empty table gives an empty result; columns other than the named ones are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytetext import edges, exact_ids, slices, spread, utf8
from .tables import bounded_batches, saved, table

MIN_DOCS, SCALE, PRIOR, TOP = 30, 1_000_000_000, 5, 50
SLICE, HELD_ROWS, BLOCK_ROWS = 4 << 20, 200_000, 50_000
COUNTS = "lang string, source string, term string, n long, docs long"
PARTS = "lang string, source string, part string, item string, value long"

#: A-Z lower-cased; 0 for what is not part of a term: term bytes are a-z and all of 0x80-0xFF
FOLD = np.zeros(256, np.uint8)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)
FOLD[0x41:0x5B] = FOLD[0x61:0x7B]


def slice_counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) of a slice, a row for each term and group; ``group`` is per document."""
    low, n_docs = FOLD[data], len(offsets) - 1
    start, end = edges(low != 0, offsets)
    raw = low.tobytes()
    key = np.fromiter(map(xxhash.xxh3_64_intdigest, map(raw.__getitem__, map(slice, start.tolist(), end.tolist()))), np.uint64, len(start))
    ids, first = exact_ids(low, start, end, key)
    of = np.repeat(np.arange(n_docs), np.diff(np.searchsorted(start, offsets)))
    held, n = np.unique(ids * n_docs + of, return_counts=True)
    cell = held // n_docs * n_groups + group[held % n_docs]
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    total = np.add.reduceat(n[order], begin) if len(begin) else np.zeros(0, np.int64)
    docs = np.diff(np.concatenate([begin, [len(cell)]]))
    size = (end - start)[first]
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.tobytes()), pa.py_buffer(low[spread(start[first], size)].tobytes()))
    return words.take(pa.array(cell[begin] // n_groups)), cell[begin] % n_groups, total, docs


def _text(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def _summed(held: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0
    for b in batches:
        data, offsets = utf8(b.column(0))
        lang, source = _text(b.column(1)).dictionary_encode(), _text(b.column(2)).dictionary_encode()
        n_sources = max(1, len(source.dictionary))
        pairs, group = np.unique(lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy(), return_inverse=True)
        for i, j in slices(offsets, SLICE):
            own = offsets[i : j + 1]
            term, g, n, docs = slice_counts(data[own[0] : own[-1]], own - own[0], group[i:j], len(pairs))
            names = [lang.dictionary.take(pa.array(pairs[g] // n_sources)), source.dictionary.take(pa.array(pairs[g] % n_sources))]
            held.append(pa.table([*names, term, pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], names=["lang", "source", "term", "n", "docs"]))
            rows += len(term)
        if rows > HELD_ROWS:
            whole = _summed(held)
            if whole.num_rows > HELD_ROWS // 2:
                yield from whole.to_batches()
                held, rows = [], 0
            else:
                held, rows = [whole], whole.num_rows
    if held:
        yield from _summed(held).to_batches()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n, docs; a term of a source may have several rows, as tasks sum their own texts only."""
    bounded_batches(docs.sparkSession)
    named = docs.select(*(F.col(f"`{c}`").cast("string").alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))))
    return named.mapInArrow(_count, COUNTS)


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, all_n (of the language), leads (on one row a term) of terms in enough documents; one shuffle."""
    each = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    each = each.withColumns({"in_docs": F.sum("docs").over(w), "all_n": F.sum("n").over(w), "first": F.min("source").over(w)})
    return each.where(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "all_n", (F.col("source") == F.col("first")).alias("leads"))


def share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / of), by long division in three steps of a thousand."""
    whole, rest = np.divmod(count, of)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + digit
    return whole + 1


def block_parts(lang: str, sources: pa.Array, totals: np.ndarray, n_terms: int, rows: pa.Table) -> pa.Table:
    """Partial pair sums and leading terms of one block of terms; ``sources`` and ``totals`` are all of the language.

    ``rows`` has source, term, n and all_n of the terms of the block, of ``n_terms`` in the language.
    """
    many = len(sources)
    g = pc.index_in(rows["source"], value_set=sources).to_numpy().astype(np.int64)
    named = pc.unique(rows["term"])
    named = named.take(pc.sort_indices(named))  # by UTF-8, so column numbers break ties
    t = pc.index_in(rows["term"], value_set=named).to_numpy().astype(np.int64)
    order = np.lexsort((t, g))
    g, t = g[order], t[order]
    n, all_n = rows["n"].to_numpy()[order], rows["all_n"].to_numpy()[order]
    of, values, tops = totals + PRIOR * n_terms, np.zeros((many, many), np.int64), (np.zeros(0, np.int64),) * 3
    if len(g):
        p, absent = share(n + PRIOR, of[g]), share(np.full(many, PRIOR), of)
        at = np.searchsorted(g, np.arange(many + 1))
        some = np.flatnonzero(at[1:] > at[:-1])  # sources with entries: reduceat takes no empty rows
        for i in range(many):
            line = np.full(len(named), absent[i])
            own = slice(at[i], at[i + 1])
            line[t[own]] = p[own]
            # every source as if it had no term of the block, then its entries put right
            values[i] = np.abs(absent[:, None] - p[own]).sum(axis=1) + (len(named) - (at[i + 1] - at[i])) * np.abs(absent - absent[i])
            values[i, some] += np.add.reduceat(np.abs(p - line[t]) - np.abs(absent[g] - line[t]), at[some])
        q = share(all_n + PRIOR, np.int64(totals.sum() + PRIOR * n_terms))
        over = np.flatnonzero(p > q)
        over = over[np.lexsort((t[over], (q - p)[over], g[over]))]
        rank = np.arange(len(over)) - np.searchsorted(g[over], g[over])
        over = over[rank < TOP]
        tops = (g[over], t[over], (p - q)[over])
    one, two = np.nonzero(~np.eye(many, dtype=bool))
    take = lambda of, index: of.take(pa.array(index))
    made = len(one), len(tops[0])
    named = named.combine_chunks() if isinstance(named, pa.ChunkedArray) else named
    return pa.table(
        [
            pa.array([lang] * sum(made), pa.string()),
            pa.concat_arrays([take(sources, one), take(sources, tops[0])]),
            pa.array(["pair"] * made[0] + ["term"] * made[1], pa.string()),
            pa.concat_arrays([take(sources, two), take(named.cast(pa.string()), tops[1])]),
            pa.array(np.concatenate([values[one, two], tops[2]]).astype(np.int64)),
        ],
        names=["lang", "source", "part", "item", "value"],
    )


def divergences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """lang, source, part, item, value, rank: the distances of source pairs and the first ``TOP`` terms of each source."""
    kept = saved(kept_terms(term_counts(docs, text, lang, source), min_docs), "terms")
    named = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source")))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("entries"), F.sum(F.col("leads").cast("long")).alias("led"))
    groups = named.join(sums, ["lang", "source"], "left").fillna(0, ["total", "entries", "led"])
    w = Window.partitionBy("lang")
    blocks = F.greatest(F.lit(1), F.ceil(F.sum("entries").over(w) / block_rows)).cast("long")
    groups = saved(groups.select("lang", "source", "total", F.sum("led").over(w).alias("n_terms"), blocks.alias("blocks")), "sources")
    langs = groups.groupBy("lang").agg(F.first("blocks").alias("blocks"))
    left = kept.join(langs, "lang").select("lang", "source", "term", "n", "all_n", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))
    right = groups.select("lang", "source", "total", "n_terms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

    def run(key: tuple, rows: pa.Table, own: pa.Table) -> pa.Table:
        order = pc.sort_indices(own["source"])
        sources = own["source"].combine_chunks().cast(pa.string()).take(order)
        return block_parts(key[0].as_py(), sources, own["total"].to_numpy()[order.to_numpy()], own["n_terms"][0].as_py(), rows)

    parts = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(run, PARTS)
    whole = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return whole.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= TOP))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


_P = f"1 + ({SCALE}::HUGEINT * ({{n}} + {PRIOR})) // ({{total}} + {PRIOR} * v)"
OP11_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
),
u AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM u GROUP BY lang, source, term),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS all_n FROM c GROUP BY lang, term HAVING sum(docs) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
size AS (SELECT lang, count(*) AS v, sum(all_n) AS all_total FROM kept GROUP BY lang),
total AS (SELECT lang, source, sum(n) AS total FROM c JOIN kept USING (lang, term) GROUP BY lang, source),
p AS MATERIALIZED (
  SELECT lang, source, term, coalesce(n, 0) AS n, {_P.format(n="coalesce(n, 0)", total="coalesce(total, 0)")} AS p, {_P.format(n="all_n", total="all_total")} AS q
  FROM g JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN total USING (lang, source) LEFT JOIN c USING (lang, source, term)
),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN far USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= {TOP}
"""
