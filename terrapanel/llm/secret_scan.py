"""Secrets in texts: three base patterns, and two character Markov models compared by log-likelihood ratio.

One model is fitted to random strings (hex, base64, URL-safe base64, capitals with digits), one to ordinary
identifiers: pairs of words of at most ``SAMPLE_DOCS`` documents (the least MD5 of their ids) joined as code joins
them, dates and numbers, and rules of one repeated sign.  Both are labelled samples of a documented size; the models
are counts of character pairs with one added, over ``ALPHABET`` characters.  A run of at least ``LEAST`` characters of
``[A-Za-z0-9+/_=-]`` is a span of kind ``markov`` if the sum of its pairs' log ratios, in thousandths of a nat, reaches
``MARGIN``.  Base spans stay as they are; a markov span may cover the same characters.

Everything is one projection of DataFrame functions over the documents: no shuffle, no Python.  Places follow from the
lengths of the matches and of the pieces between them; running sums go by blocks of ``BLOCK``, so a text with very many
matches stays cheap.  Only the counts of character pairs come to the driver (at most 2 x 128 x 128 rows).

Defined cases: null or empty text has no spans; null ids are carried through and give no sample; repeated rows are
scanned each and sampled once; an empty table gives an empty result, and models without ordinary words; columns other than the named
ones are neither read nor returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

KINDS = ("assign", "access", "hex", "markov")
#: kind: pattern, the group whose length counts, and its least length
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
LEAST, MARGIN, ALPHABET, BLOCK = 20, 12_000, 67, 256
RANDOM_SAMPLES, NUMBER_SAMPLES, SAMPLE_DOCS = 4000, 2000, 500
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
SPANS = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda a, x: a + x)


def running(sizes: Column) -> Column:
    """Running sums of an array of ints, by blocks."""

    def whole(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: F.slice(s, b * BLOCK + 1, F.lit(BLOCK)))

        def joined(parts: Column) -> Column:
            sums = F.transform(parts, total)
            return let(sums, lambda t: F.flatten(F.transform(parts, lambda own, b: let(total(F.slice(t, F.lit(1), b)), lambda base: F.transform(own, lambda _, i: base + total(F.slice(own, F.lit(1), i + 1)))))))

        return let(blocks, joined)

    return let(sizes, whole)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """start, end (code points, end exclusive) and the group's string of every match."""
    pieces, found, value = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(lengths: Column) -> Column:
        ends = running(F.zip_with(pieces, lengths, lambda p, n: F.length(p) + F.coalesce(n, F.lit(0))))
        return F.zip_with(F.zip_with(F.slice(ends, F.lit(1), F.size(lengths)), lengths, lambda e, n: F.struct((e - n).alias("start"), e.alias("end"))), value, lambda at, v: F.struct(at["start"].alias("start"), at["end"].alias("end"), v.alias("value")))

    some = let(F.transform(found, F.length), placed)
    return F.when(text.rlike(pattern), some).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def as_spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """token, label: 1 for random strings, 0 for ordinary identifiers, numbers and rules."""
    spark = docs.sparkSession
    h = F.sha2(F.concat(F.lit("random:"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(h))
    random = spark.range(RANDOM_SAMPLES).select(
        F.when(F.col("id") % 4 == 0, F.substring(h, 1, 40)).when(F.col("id") % 4 == 1, F.substring(b64, 1, 40)).when(F.col("id") % 4 == 2, F.substring(F.translate(b64, "+/", "-_"), 1, 40)).otherwise(F.upper(F.regexp_replace(b64, "[^A-Za-z0-9]", ""))).alias("token"), F.lit(1).alias("label")
    )
    two = lambda n: F.lpad((F.col("id") % n + 1).cast("string"), 2, "0")
    date = F.concat((F.col("id") % 40 + 1990).cast("string"), two(12), two(28), F.lpad((F.col("id") * 7919 % 1_000_000).cast("string"), 6, "0"))
    rule = F.repeat(F.element_at(F.split(F.lit("+/_=-xa"), ""), (F.col("id") % 7 + 1).cast("int")), 40)
    numbers = spark.range(NUMBER_SAMPLES).select(F.explode(F.array(date, rule)).alias("token"), F.lit(0).alias("label"))
    own = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("id is not null and text is not null")
    # hashes choose first, so no task gathers texts; then at most SAMPLE_DOCS pairs of hashes are broadcast
    named = own.select(F.md5("id").alias("i"), F.md5("text").alias("t")).distinct()
    chosen = F.broadcast(named.orderBy("i", "t").limit(SAMPLE_DOCS))
    own = own.withColumn("i", F.md5("id")).withColumn("t", F.md5("text"))
    own = own.join(chosen.select(F.col("i").alias("ci"), F.col("t").alias("ct")), (F.col("i") == F.col("ci")) & (F.col("t") == F.col("ct")), "left_semi").groupBy("i", "t").agg(F.first("text").alias("text"))  # repeated rows once
    own = own.select(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))

    def joined(w: Column, i: Column) -> Column:
        after = F.coalesce(F.get("w", i + 1), F.lit("x"))
        camel = F.concat(w, F.upper(F.substring(after, 1, 1)), F.substring(after, 2, 1_000_000))
        return F.when(i % 5 == 0, F.concat(w, F.lit("_"), after)).when(i % 5 == 1, F.concat(w, F.lit("-"), after)).when(i % 5 == 2, camel).when(i % 5 == 3, F.concat(w, F.lit("/"), after)).otherwise(F.concat(w, (i % 100).cast("string")))

    ordinary = own.select(F.explode(F.transform("w", joined)).alias("token"), F.lit(0).alias("label"))
    return random.unionByName(numbers).unionByName(ordinary)


def fit(labelled: DataFrame) -> list[int]:
    """Log ratios of the two models by 128 * previous character + character (previous 0: the beginning)."""
    at = F.explode(F.sequence(F.lit(1), F.length("token"))).alias("i")
    pairs = labelled.where("length(token) > 0").select("label", "token", at)
    pairs = pairs.select("label", F.when(F.col("i") == 1, 0).otherwise(F.ascii(F.expr("substring(token, i - 1, 1)"))).alias("p"), F.ascii(F.expr("substring(token, i, 1)")).alias("c"))
    counts = {(r["label"], r["p"], r["c"]): r["n"] for r in pairs.where("p < 128 and c < 128").groupBy("label", "p", "c").agg(F.count("*").alias("n")).collect()}
    before: dict[tuple[int, int], int] = {}
    for (label, p, _), n in counts.items():
        before[label, p] = before.get((label, p), 0) + n
    chance = lambda label, p, c: (counts.get((label, p, c), 0) + 1.0) / (before.get((label, p), 0) + ALPHABET)
    return [math.floor(1000 * math.log(chance(1, p, c) / chance(0, p, c)) + 0.5) for p in range(128) for c in range(128)]


def ratio(value: Column, weights: list[int]) -> Column:
    """Log-likelihood ratio of a string, random against ordinary."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<long>")  # folded to one literal
    start = F.struct(F.lit(0).alias("p"), F.lit(0).cast("long").alias("s"))

    def step(a: Column, c: Column) -> Column:
        return F.struct(F.ascii(c).alias("p"), (a["s"] + F.element_at(table, a["p"] * 128 + F.ascii(c) + 1)).alias("s"))

    return F.aggregate(F.split(value, ""), start, step, lambda a: a["s"])


def find_secrets(docs: DataFrame, weights: list[int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (start, kind, end), sorted, of every row; kind counts in KINDS."""
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    t = F.col("text")
    long = lambda n: lambda m: F.length(m["value"]) >= n
    kinds = [as_spans(F.filter(matches(t, p, g), long(n)), k) for k, (p, g, n) in BASE.items()]
    markov = as_spans(F.filter(matches(t, CANDIDATE), lambda m: ratio(m["value"], weights) >= MARGIN), "markov")
    return d.select("doc_id", F.array_sort(F.concat(*kinds, markov)).cast(SPANS).alias("spans"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, fit(samples(docs)))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    name = F.array(*map(F.lit, KINDS))
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = listed(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count("markov").alias("n_markov"))


def _spans_sql(kind: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""SELECT rn, {kind} AS k, list_sum(list_transform(pc[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)::BIGINT AS s, len(m[i]) AS n, m[i] AS v
 FROM (SELECT rn, m, g, pc, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rn, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, string_split_regex(t, '{pattern}') AS pc FROM d WHERE regexp_matches(t, '{pattern}')))
 WHERE len(g[i]) >= {least}"""


_ASSIGN = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")" + BASE["assign"][0].partition("key)")[2]
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT i, sha256('random:' || i) AS h, to_base64(unhex(sha256('random:' || i))) AS b FROM range({RANDOM_SAMPLES}) x(i)),
q AS (SELECT i FROM range({NUMBER_SAMPLES}) x(i)),
w AS (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM (SELECT text FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) ORDER BY md5(CAST(doc_id AS VARCHAR)), md5(text) LIMIT {SAMPLE_DOCS})),
wi AS (SELECT w[i + 1] AS a, coalesce(w[i + 2], 'x') AS z, i FROM (SELECT w, unnest(range(0, len(w))) AS i FROM w)),
sample AS (SELECT CASE i % 4 WHEN 0 THEN h[1:40] WHEN 1 THEN b[1:40] WHEN 2 THEN translate(b, '+/', '-_')[1:40] ELSE upper(regexp_replace(b, '[^A-Za-z0-9]', '', 'g')) END AS token, 1 AS label FROM r
 UNION ALL SELECT (i % 40 + 1990) || lpad(CAST(i % 12 + 1 AS VARCHAR), 2, '0') || lpad(CAST(i % 28 + 1 AS VARCHAR), 2, '0') || lpad(CAST(i * 7919 % 1000000 AS VARCHAR), 6, '0'), 0 FROM q
 UNION ALL SELECT repeat('+/_=-xa'[i % 7 + 1], 40), 0 FROM q
 UNION ALL SELECT CASE i % 5 WHEN 0 THEN a || '_' || z WHEN 1 THEN a || '-' || z WHEN 2 THEN a || upper(z[1]) || z[2:] WHEN 3 THEN a || '/' || z ELSE a || (i % 100) END, 0 FROM wi),
pairs AS (SELECT label, CASE WHEN i = 1 THEN 0 ELSE ascii(token[i - 1]) END AS p, ascii(token[i]) AS c FROM (SELECT label, token, unnest(range(1, len(token) + 1)) AS i FROM sample)),
cnt AS (SELECT p, c, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0 FROM pairs GROUP BY p, c),
bef AS (SELECT p, count(*) FILTER (WHERE label = 1) AS b1, count(*) FILTER (WHERE label = 0) AS b0 FROM pairs GROUP BY p),
grid AS (SELECT a.i AS p, b.i AS c FROM range(128) a(i), range(128) b(i)),
wt AS (SELECT grid.p, grid.c, CAST(floor(1000 * ln(((coalesce(n1, 0) + 1.0) / (coalesce(b1, 0) + {ALPHABET}.0)) / ((coalesce(n0, 0) + 1.0) / (coalesce(b0, 0) + {ALPHABET}.0))) + 0.5) AS BIGINT) AS w
 FROM grid LEFT JOIN cnt ON grid.p = cnt.p AND grid.c = cnt.c LEFT JOIN bef ON grid.p = bef.p),
base AS ({_spans_sql(0, _ASSIGN, 2, 12)} UNION ALL {_spans_sql(1, BASE["access"][0], 0, 18)} UNION ALL {_spans_sql(2, BASE["hex"][0], 0, 16)}),
cand AS ({_spans_sql(3, CANDIDATE, 0, LEAST)}),
scored AS (SELECT x.v, sum(w) AS llr FROM (SELECT v, CASE WHEN i = 1 THEN 0 ELSE ascii(v[i - 1]) END AS p, ascii(v[i]) AS c FROM (SELECT v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT DISTINCT v FROM cand))) x JOIN wt ON x.p = wt.p AND x.c = wt.c GROUP BY x.v),
spans AS (SELECT rn, k, s, s + n AS e FROM base UNION ALL SELECT rn, k, s, s + n FROM cand JOIN scored USING (v) WHERE llr >= {MARGIN}),
per AS (SELECT rn, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, count(*) FILTER (WHERE k = 3) AS n_markov,
 string_agg(['assign', 'access', 'hex', 'markov'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(['assign', 'access', 'hex', 'markov'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM spans GROUP BY rn)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_markov, 0) AS n_markov
FROM d LEFT JOIN per USING (rn)
"""
