"""Quality of texts by weak supervision: rules vote or abstain, and what their votes are worth is estimated from the votes.

One pass over the whole texts counts what the rules look at (``measures``).  Each of ``RULES`` then votes good (1), bad (-1)
or abstains (0); votes are plain columns.  Expectation-maximisation gives the share of good documents and, per rule, how
often it votes good on good and bad on bad documents when it votes at all.  It needs only how many documents have each
pattern of votes, a table of at most 3 ** len(RULES) rows whatever the corpus (a bound of ``MAX_PATTERNS`` that is
checked), so all documents count and none comes to the driver.  It starts where all-must-pass filtering would end (good:
no rule objects) and runs a fixed number of rounds; a document is kept where the posterior probability of good reaches
``KEEP``.  A rule that often objects alone thus loses its veto.

Words are runs of other than space and ASCII white space, lines are split at \\n.  Words and lines are equal by their
bytes: hashes group them and every slice is compared.  A text is never cut; a slice is about one MB of whole texts.

Defined cases: null or empty text has no words, so it is never kept; null ids are carried through; repeated rows are
measured and counted each; very long texts are slices of their own; an empty table gives an empty result; columns other
than the named ones are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import edges, exact_ids, mix64, slice_hashes, slices, utf8
from .tables import saved, table, text_rows

WINDOW = 5
KEEP, ROUNDS, MAX_PATTERNS = 0.5, 20, 3**11
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_letters", "n_capitals", "n_shouts", "n_echoes", "n_ended_lines"]
MEASURES = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
#: rule: (objects, approves) as conditions on the counts that Spark and SQL read alike; neither: it abstains
RULES = {
    "length": ("n_words < 20", "n_words >= 50"),
    "word_length": ("word_chars > 10 * n_words OR 2 * word_chars < 5 * n_words", "word_chars <= 8 * n_words AND word_chars >= 3 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "dense_symbols": ("4 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "lines": ("10 * n_dup_lines > 3 * n_lines", "20 * n_dup_lines <= n_lines AND n_lines >= 2"),
    "repeats": ("5 * n_repeat_words > n_words", "20 * n_repeat_words <= n_words"),
    "echoes": ("10 * n_echoes > n_words", "50 * n_echoes <= n_words"),
    "capitals": ("10 * n_capitals > 3 * n_letters", "10 * n_capitals <= n_letters"),
    "shouts": ("10 * n_shouts > n_words", "100 * n_shouts <= n_words"),
    "letters": ("10 * n_letters < 7 * n_chars", "4 * n_letters >= 3 * n_chars"),
    "endings": ("10 * n_ended_lines < 3 * n_lines", "10 * n_ended_lines >= 8 * n_lines"),
}
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"

_ORD = np.arange(256)
SPACE = (_ORD == 0x20) | ((_ORD >= 0x09) & (_ORD <= 0x0D))
SYMBOL = np.isin(_ORD, [ord(c) for c in "#*$%&|<>"])
LEAD = (_ORD < 0x80) | (_ORD >= 0xC0)  # the first byte of a code point
CAPITAL = (_ORD >= 0x41) & (_ORD <= 0x5A)
STOP = np.isin(_ORD, [ord(c) for c in ".!?"])
LETTER = CAPITAL | ((_ORD >= 0x61) & (_ORD <= 0x7A)) | (_ORD >= 0xC0)


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words in windows of ``WINDOW`` words that a document has twice or more."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    of = np.repeat(np.arange(n_docs), np.diff(doc))
    at = np.flatnonzero(of[:n] == of[WINDOW - 1 :])  # windows within a document
    key = of[at].astype(np.uint64)
    for k in range(WINDOW):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64))
    alike = np.sort(key)
    if (alike[1:] != alike[:-1]).all():
        return np.zeros(n_docs, np.int64)
    # windows whose hash stands twice or more, sorted by document and words themselves
    often = np.isin(key, alike[1:][alike[1:] == alike[:-1]])
    at = at[often]
    words = np.stack([of[at], *(ids[at + k] for k in range(WINDOW))])
    order = np.lexsort(words)
    words = words[:, order]
    equal = (words[:, 1:] == words[:, :-1]).all(axis=0)
    twice = np.zeros(len(at), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    covered = np.zeros(len(ids) + 1, np.int64)
    begin = at[order][twice]
    np.add.at(covered, begin, 1)
    np.add.at(covered, begin + WINDOW, -1)
    hit = np.cumsum(covered)[:-1] > 0
    return _per_doc(hit, doc)


def counted(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each document of a slice."""
    n_docs = len(offsets) - 1
    solid = ~SPACE[data]
    start, end = edges(solid, offsets)
    doc = np.searchsorted(start, offsets)
    ids, _ = exact_ids(data, start, end, slice_hashes(data, start, end))
    # lines: between the \n of a document, the last one ends with it
    ends = np.sort(np.concatenate([np.flatnonzero(data == 0x0A), offsets[1:]]))
    begins = np.sort(np.concatenate([np.flatnonzero(data == 0x0A) + 1, offsets[:-1]]))
    words = np.searchsorted(start, ends) - np.searchsorted(start, begins)
    begins, ends = begins[words > 0], ends[words > 0]
    line_doc = np.searchsorted(offsets, begins, "right") - 1
    last = np.searchsorted(start, ends) - 1  # the last word of each line
    line_ids, _ = exact_ids(data, begins, ends, slice_hashes(data, begins, ends))
    _, seen = np.unique(line_doc * (len(line_ids) + 1) + line_ids, return_index=True)
    again = np.ones(len(line_ids), bool)
    again[seen] = False
    same = ids[1:] == ids[:-1]
    echo = np.zeros(len(ids), bool)
    echo[1:] = same
    first = doc[:-1][doc[:-1] < doc[1:]]
    echo[first] = False
    lead = LEAD[data]
    return {
        "n_words": np.diff(doc),
        "word_chars": _per_doc(solid & lead, offsets),
        "n_symbols": _per_doc(SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_doc[again], minlength=n_docs),
        "n_repeat_words": _repeated(ids, doc, n_docs),
        "n_lines": np.bincount(line_doc, minlength=n_docs),
        "n_chars": _per_doc(lead, offsets),
        "n_letters": _per_doc(LETTER[data], offsets),
        "n_capitals": _per_doc(CAPITAL[data], offsets),
        "n_shouts": _per_doc(data == 0x21, offsets),
        "n_echoes": _per_doc(echo, doc),
        "n_ended_lines": np.bincount(line_doc[STOP[data[end[last] - 1]]], minlength=n_docs),
    }


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``COUNTS`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(1))
            for i, j in slices(offsets):
                own = offsets[i : j + 1]
                found = counted(data[own[0] : own[-1]], own - own[0])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", *COUNTS])

    return text_rows(docs, doc_id, text).mapInArrow(run, MEASURES)


def votes(rules: dict[str, tuple[str, str]] = RULES) -> list[Column]:
    return [F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).alias(f"v_{name}") for name, (bad, good) in rules.items()]


def estimate(patterns: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(share of good, chance of a good vote on good, of a bad vote on bad, posterior of each pattern).

    ``patterns`` has a row a pattern of votes and a column a rule, ``n`` how many documents have it.
    """
    good, bad = (patterns == 1).astype(float), (patterns == -1).astype(float)
    post = np.where(bad.any(axis=1), 0.02, 0.98)
    for _ in range(rounds):
        w, u = n * post, n * (1 - post)
        share = (w.sum() + 1) / (n.sum() + 2)
        right = (w @ good + 1) / (w @ (good + bad) + 2)
        caught = (u @ bad + 1) / (u @ (good + bad) + 2)
        odds = np.log(share / (1 - share)) + good @ np.log(right / (1 - caught)) + bad @ np.log((1 - right) / caught)
        post = 1 / (1 + np.exp(-odds))
    return share, right, caught, post


def judged(measured: DataFrame, rules: dict[str, tuple[str, str]] = RULES, keep: float = KEEP, base_failed: str = BASE_FAILED) -> DataFrame:
    """The counts with the votes, ``posterior``, ``base_failed`` and ``kept``; ``measured`` is read twice."""
    if 3 ** len(rules) > MAX_PATTERNS:
        raise ValueError(f"at most {MAX_PATTERNS} patterns of votes: fewer rules, please")
    spark, names = measured.sparkSession, [f"v_{r}" for r in rules]
    voted = measured.select("*", *votes(rules))
    patterns = sorted(tuple(r) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect())
    counts = np.array(patterns, np.int64).reshape(len(patterns), len(names) + 1)
    post = estimate(counts[:, :-1], counts[:, -1].astype(float))[-1] if len(counts) else np.zeros(0)
    found = spark.createDataFrame([(*map(int, p[:-1]), float(x)) for p, x in zip(patterns, post, strict=True)], ", ".join(f"{c} int" for c in names) + ", posterior double")
    out = voted.join(F.broadcast(found), names)  # at most MAX_PATTERNS short rows
    failed = F.expr(base_failed)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= keep))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = saved(measures(table(spark, sf_dir, "documents")), "measures")
    return judged(measured).select("doc_id", *COUNTS[:5], "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def _rounds() -> str:
    """The rounds of ``estimate`` as one SQL step each: params -> posterior -> params."""
    steps = []
    for i in range(ROUNDS):
        steps.append(f"""
share{i} AS MATERIALIZED (SELECT (sum(n * post) + 1) / (sum(n) + 2) AS share FROM post{i}),
rule{i} AS MATERIALIZED (
  SELECT rule, (sum(CASE WHEN v = 1 THEN n * post ELSE 0 END) + 1) / (sum(CASE WHEN v <> 0 THEN n * post ELSE 0 END) + 2) AS hit,
    (sum(CASE WHEN v = -1 THEN n * (1 - post) ELSE 0 END) + 1) / (sum(CASE WHEN v <> 0 THEN n * (1 - post) ELSE 0 END) + 2) AS caught
  FROM cast_votes JOIN post{i} USING (pattern) GROUP BY rule
),
post{i + 1} AS MATERIALIZED (
  SELECT pattern, any_value(n) AS n, 1 / (1 + exp(-(any_value(ln(share / (1 - share))) + sum(CASE v WHEN 1 THEN ln(hit / (1 - caught)) WHEN -1 THEN ln((1 - hit) / caught) ELSE 0 END)))) AS post
  FROM cast_votes JOIN rule{i} USING (rule) JOIN post{i} USING (pattern) CROSS JOIN share{i} GROUP BY pattern
)""")
    return ",".join(steps)


_VOTES = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for bad, good in RULES.values())
_SPLIT = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
OP12_SQL = f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {_SPLIT} AS words FROM documents),
line AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM t),
lines AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (regexp_matches(line, '[.!?][\\x20\\x09-\\x0D]*$')) AS n_ended_lines FROM line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k),
win AS (SELECT k, unnest(range(1, len(words) - {WINDOW - 2})) AS pos, unnest(list_transform(range(1, len(words) - {WINDOW - 2}), lambda i: array_to_string(words[i:i + {WINDOW - 1}], ' '))) AS w FROM t WHERE len(words) >= {WINDOW}),
twice AS (SELECT k, pos FROM win QUALIFY count(*) OVER (PARTITION BY k, w) > 1),
hit AS (SELECT k, count(DISTINCT pos + i) AS n_repeat_words FROM twice CROSS JOIN range({WINDOW}) AS s(i) GROUP BY k),
m AS MATERIALIZED (
  SELECT k, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_ended_lines, 0) AS n_ended_lines, length(text) AS n_chars,
    length(regexp_replace(text, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts,
    len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_echoes
  FROM t LEFT JOIN lines USING (k) LEFT JOIN hit USING (k)
),
v AS MATERIALIZED (SELECT *, [{_VOTES}] AS pattern, {BASE_FAILED} AS base_failed FROM m),
counts AS MATERIALIZED (SELECT pattern, count(*) AS n FROM v GROUP BY pattern),
cast_votes AS MATERIALIZED (SELECT pattern, unnest(pattern) AS v, unnest(range(1, {len(RULES) + 1})) AS rule FROM counts),
post0 AS MATERIALIZED (SELECT pattern, n, CASE WHEN list_contains(pattern, -1) THEN 0.02 ELSE 0.98 END AS post FROM counts),{_rounds()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND post >= {KEEP} AS kept, round(post, 6) AS posterior
FROM v JOIN post{ROUNDS} USING (pattern)
"""
