"""Temporal URL list filter: dated list entries become validity intervals, captures join them as of fetch time.

A list entry is (kind, pattern, verdict, action, effective).  ``kind`` is ``host`` (exactly this host), ``domain``
(this host and everything below it), ``prefix`` (host + path, up to a path separator) or ``url`` (host + path +
query, scheme and fragment ignored).  ``action`` is ``add`` or ``remove``; an entry holds from ``effective`` until the
next entry of the same (kind, pattern, verdict).  ``verdict`` is ``block`` or ``allow``.

A capture has a few candidate keys (its host, each parent domain, each path prefix, its URL).  They meet the
intervals by an equi-join on (key, time bucket, salt); the interval test is a filter on the joined row, so no range
or cross join appears.  Keys that hold over a thousandth of all candidates (at most 1000 x candidates a capture, a
proven bound for the broadcast) are salted: captures are dealt over ``SALTS`` parts, the few list rows are repeated.

Decision: an allow interval wins over a block interval; among equals the longer key, then the larger key string.

Defined cases: a null or empty URL, or one without a host, has no candidates and is kept (``blocked`` false, host
null); a null fetch time matches nothing; entries with a null field are ignored; several entries of one key at one
instant: ``remove`` wins; a URL of any length gives at most as many keys as the deepest entries have parts; identical (id, url, time) rows are returned once; empty tables give empty results or
nothing blocked; columns other than the named ones are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import table

SALTS = 32
HOT_SHARE = 1000
BUCKET_DAYS = 92


def bucket(c):
    return F.floor(F.unix_seconds(c) / (86400 * BUCKET_DAYS))


def intervals(entries: DataFrame, until=None) -> DataFrame:
    """key, verdict, valid_from, valid_to (exclusive; null: open) of every time an entry is active."""
    e = entries.select(
        F.concat_ws(":", F.lower("kind"), F.lower("pattern")).alias("key"), F.lower("verdict").alias("verdict"), F.lower("action").alias("action"),
        F.col("effective").cast("timestamp").alias("valid_from"), (F.col("kind").isNotNull() & F.col("pattern").isNotNull()).alias("named"),
    ).where("named and verdict in ('block', 'allow') and action in ('add', 'remove') and valid_from is not null")
    e = e.groupBy("key", "verdict", "valid_from").agg(F.max("action").alias("action"))
    e = e.withColumn("valid_to", F.lead("valid_from").over(W.partitionBy("key", "verdict").orderBy("valid_from")))
    return e.where("action = 'add'").select("key", "verdict", "valid_from", "valid_to")


def parsed(captures: DataFrame, capture_id: str = "page_id", url: str = "url", fetched: str = "fetch_time") -> DataFrame:
    """id, url, fetch_time, host and rest (path and query without fragment) of each distinct capture."""
    c = captures.select(F.col(f"`{capture_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{fetched}`").cast("timestamp").alias("fetch_time")).distinct()
    bare = F.regexp_extract("url", r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)(?::\d*)?([^#\s]*)", 1)
    rest = F.regexp_extract("url", r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)(?::\d*)?([^#\s]*)", 2)
    return c.withColumn("host", F.nullif(F.rtrim(F.lower(bare), F.lit(".")), F.lit(""))).withColumn("rest", F.coalesce(rest, F.lit("")))


def deepest(entries: DataFrame) -> tuple[int, int]:
    """The most labels of a listed domain and the most steps of a listed prefix."""
    n = lambda kind, cut: F.max(F.when(F.lower("kind") == kind, F.size(F.split("pattern", cut))))
    r = entries.agg(n("domain", r"\."), n("prefix", "/")).first()
    return r[0] or 0, max(0, (r[1] or 0) - 1)


def candidates(c: DataFrame, labels_listed: int, steps_listed: int) -> DataFrame:
    """A row for every key under which the list may name the capture: none deeper than the list's deepest entries, so that the
    keys of a very long URL do not grow with its length."""
    labels, path = F.split("host", r"\."), F.regexp_extract("rest", r"^[^?]*", 0)
    domains = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (labels_listed - 1)), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    steps = F.array_remove(F.split(path, "/"), "")
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(steps), F.lit(steps_listed))), lambda i: F.concat(F.lit("prefix:"), F.col("host"), F.lit("/"), F.lower(F.array_join(F.slice(steps, 1, i), "/"))))
    whole = F.array(F.concat(F.lit("host:"), F.col("host")), F.concat(F.lit("url:"), F.col("host"), F.lower("rest")))
    return c.where("host is not null").select("page_id", "url", "fetch_time", "host", F.explode(F.array_distinct(F.concat(whole, domains, prefixes))).alias("key"))


def filter_urls(captures: DataFrame, entries: DataFrame, capture_id: str = "page_id", url: str = "url", fetched: str = "fetch_time") -> DataFrame:
    """page_id, url, fetch_time, host, blocked, verdict, matched_key, valid_from, valid_to of each capture."""
    base = parsed(captures, capture_id, url, fetched)
    cand, active = candidates(base, *deepest(entries)), intervals(entries)
    span = base.agg(F.min("fetch_time").alias("lo"), F.max("fetch_time").alias("hi"), F.count("*").alias("n")).first()
    if not span["n"]:
        span = None
    lo, hi = (F.lit(span["lo"]), F.lit(span["hi"])) if span and span["lo"] else (F.to_timestamp(F.lit("1970-01-01")), F.to_timestamp(F.lit("1970-01-01")))
    limit = max(50, (span["n"] if span else 0) // HOT_SHARE)
    hot = F.broadcast(cand.groupBy("key").count().where(F.col("count") > limit).select("key", F.lit(True).alias("hot")))
    # intervals are cut to the captured period, then listed under each time bucket they touch
    active = active.where((active.valid_from <= hi) & (active.valid_to.isNull() | (active.valid_to > lo)))
    active = active.join(hot, "key", "left").select(
        "key", "verdict", "valid_from", "valid_to",
        F.explode(F.sequence(bucket(F.greatest("valid_from", lo)), bucket(F.least(F.coalesce("valid_to", hi), hi)))).alias("bucket"),
        F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0)).alias("salts"),
    ).select("key", "bucket", "verdict", "valid_from", "valid_to", F.explode("salts").alias("salt"))
    salted = cand.join(hot, "key", "left").select("page_id", "url", "fetch_time", "key", bucket("fetch_time").alias("bucket"), F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", "url", "fetch_time"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    met = salted.join(active, ["key", "bucket", "salt"]).where("fetch_time >= valid_from and (valid_to is null or fetch_time < valid_to)")
    best = F.max(F.struct((F.col("verdict") == "allow").alias("allow"), F.length("key").alias("n"), "key", "valid_from", "valid_to"))
    met = met.groupBy("page_id", "url", "fetch_time").agg(best.alias("best"))
    ids = ("page_id", "url", "fetch_time")
    met = met.select(*(F.col(c).alias(f"met_{c}") for c in ids), "best")
    same = [F.col(c).eqNullSafe(F.col(f"met_{c}")) for c in ids]
    return base.join(met, same, "left").select(
        *ids, "host",
        F.coalesce(~F.col("best.allow"), F.lit(False)).alias("blocked"),
        F.when(F.col("best.allow"), "allow").when(~F.col("best.allow"), "block").alias("verdict"),
        F.col("best.key").alias("matched_key"), F.col("best.valid_from").alias("valid_from"), F.col("best.valid_to").alias("valid_to"),
    )


#: A dated list: (kind, pattern, verdict, action, day of 2024 and 2025 counted from 0).
LISTED = [
    ("domain", "spam-farm.example.org", "block", "add", 0), ("domain", "spam-farm.example.org", "block", "remove", 400), ("domain", "spam-farm.example.org", "block", "add", 500),
    ("domain", "cheap-pills.example.com", "block", "add", 100), ("host", "www.cheap-pills.example.com", "allow", "add", 300), ("host", "www.cheap-pills.example.com", "allow", "remove", 320),
    ("domain", "tionsh.example.net", "block", "add", 200), ("domain", "tionsh.example.net", "block", "remove", 260), ("prefix", "tionsh.example.net/en", "block", "add", 350),
    ("prefix", "blog.tionble.example.com/fr", "block", "add", 10), ("domain", "example.net", "block", "add", 700),
]


def listed(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The query's list: LISTED, and for about one host in eight an add, a removal and another add, dated by its md5."""
    fixed = spark.createDataFrame(LISTED, "kind string, pattern string, verdict string, action string, day int")
    h = pages.select(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("pattern")).where("pattern <> ''").distinct().withColumn("m", F.md5("pattern"))
    n = lambda at, k: F.conv(F.substring("m", at, k), 16, 10).cast("int")
    days = [("add", n(2, 4) % 600), ("remove", n(2, 4) % 600 + n(6, 2)), ("add", n(2, 4) % 600 + n(6, 2) + n(8, 2))]
    own = h.where(F.substring("m", 1, 1).isin("0", "1")).select(F.lit("host").alias("kind"), "pattern", F.lit("block").alias("verdict"), F.explode(F.array(*[F.struct(F.lit(a).alias("action"), d.alias("day")) for a, d in days])).alias("x")).select("kind", "pattern", "verdict", "x.action", "x.day")
    return fixed.unionByName(own).withColumn("effective", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, day)"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched at an hour of 2024 and 2025 that follows from its id, against the dated list."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_time", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(pmod(page_id * 7919, 17520) as int))"))
    out = filter_urls(captures, listed(spark, pages))
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("page_id", "host", day("fetch_time").alias("fetched"), "blocked", "verdict", "matched_key", day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"))


_VALUES = ", ".join(f"('{k}', '{p}', '{v}', '{a}', {d})" for k, p, v, a, d in LISTED)
OP1_SQL = rf"""
WITH hosts AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h FROM pages),
hm AS (SELECT h, ('0x' || substr(md5(h), 2, 4))::INT % 600 AS a, ('0x' || substr(md5(h), 6, 2))::INT AS b, ('0x' || substr(md5(h), 8, 2))::INT AS c FROM hosts WHERE h <> '' AND substr(md5(h), 1, 1) IN ('0', '1')),
e0 AS (SELECT * FROM (VALUES {_VALUES}) AS v(kind, pattern, verdict, action, day)
 UNION ALL SELECT 'host', h, 'block', 'add', a FROM hm UNION ALL SELECT 'host', h, 'block', 'remove', a + b FROM hm UNION ALL SELECT 'host', h, 'block', 'add', a + b + c FROM hm),
e1 AS (SELECT kind || ':' || pattern AS key, verdict, day, max(action) AS action FROM e0 GROUP BY ALL),
e2 AS (SELECT *, lead(day) OVER (PARTITION BY key, verdict ORDER BY day) AS upto FROM e1),
iv AS (SELECT key, verdict, TIMESTAMP '2024-01-01' + to_days(day) AS f, TIMESTAMP '2024-01-01' + to_days(upto) AS t FROM e2 WHERE action = 'add'),
c AS (SELECT DISTINCT page_id, url, TIMESTAMP '2024-01-01' + to_hours(CAST((page_id * 7919) % 17520 AS INT)) AS seen, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host,
 lower(regexp_extract(url, '^[a-z]+://[^/:?#]+(?::[0-9]*)?([^#]*)', 1)) AS rest FROM pages),
p AS (SELECT *, list_filter(string_split(regexp_extract(rest, '^[^?]*'), '/'), lambda x: x <> '') AS steps, string_split(host, '.') AS labels FROM c),
cand AS (SELECT page_id, url, seen, 'host:' || host AS key FROM p UNION SELECT page_id, url, seen, 'url:' || host || rest FROM p
 UNION SELECT page_id, url, seen, 'domain:' || array_to_string(labels[i:], '.') FROM (SELECT *, unnest(range(1, len(labels))) AS i FROM p)
 UNION SELECT page_id, url, seen, 'prefix:' || host || '/' || coalesce(array_to_string(steps[1:i], '/'), '') FROM (SELECT *, unnest(range(0, len(steps) + 1)) AS i FROM p)),
met AS (SELECT cand.*, verdict, f, t, row_number() OVER (PARTITION BY page_id, url, seen ORDER BY verdict = 'allow' DESC, length(cand.key) DESC, cand.key DESC) AS r
 FROM cand JOIN iv ON cand.key = iv.key AND seen >= f AND (t IS NULL OR seen < t))
SELECT c.page_id, c.host, strftime(c.seen, '%Y-%m-%d %H:%M:%S') AS fetched, coalesce(m.verdict = 'block', false) AS blocked, m.verdict, m.key AS matched_key,
 strftime(m.f, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(m.t, '%Y-%m-%d %H:%M:%S') AS valid_to
FROM c LEFT JOIN (SELECT * FROM met WHERE r = 1) m ON c.page_id = m.page_id AND c.url = m.url AND c.seen = m.seen
"""
