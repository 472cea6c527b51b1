"""Source divergence, quality rules and fill-in-the-middle forms."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import bytetext, fill_middle, quality_rules, source_divergence
from terrapanel.llm.tables import table

from .test_filters import DOCS, LONG, edge_rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


def test_exact_ids_whatever_the_hash():
    rng = random.Random(3)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 2, 7, 8, 9, 17, 300]))) for _ in range(400)]
    data, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    for key in (np.zeros(400, np.uint64), np.array([len(w) % 3 for w in words], np.uint64), bytetext.slice_hashes(data, start, end)):
        ids, first = bytetext.exact_ids(data, start, end, key)
        assert [words[f] for f in first[ids]] == words and len(set(ids.tolist())) == len(set(words))


# ---------------------------------------------------------------- source divergence


def brute_divergence(rows, least):
    """Rows of (text, lang, source)."""
    rows = [(t or "", a or "", s or "") for t, a, s in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        counts, docs = defaultdict(Counter), Counter()
        for t, a, s in rows:
            if a == lang:
                found = TERM.findall(t.translate(LOWER))
                counts[s].update(found)
                docs.update(set(found))
        kept = sorted(w for w in docs if docs[w] >= least)
        whole = Counter({w: sum(c[w] for c in counts.values()) for w in kept})
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}
        q, p = share(whole), {s: share(c) for s, c in [*counts.items(), *((s, Counter()) for t, a, s in rows if a == lang and s not in counts)]}
        for s in p:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in p if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i) for i, (v, item) in enumerate(order, 1) if part == "pair" or i <= 50}
    return out


@pytest.mark.parametrize("block", [7, 10**6])
def test_divergence_against_brute_force(spark, block):
    rng = random.Random(block)
    vocab = ["a", "B", "straße", "naïve", "ZZ", "日本", "é", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9))]
    rows = [(" ".join(rng.choices(vocab, k=rng.randint(0, 60))) + rng.choice(["", "1x2", "\n"]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None])) for _ in range(120)]
    rows += [rows[0], (None, "en", "none"), ("", "xx", "only"), ("rare words", "yy", "s1"), ("other ones", "yy", "s2"), ("wörd " * 30_000, "en", "s1")]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, term string").repartition(5)
    got = source_divergence.divergences(d, min_docs=3, block_rows=block).collect()
    assert len(got) == len(set(got))
    assert set(map(tuple, got)) == brute_divergence(rows, 3)


def test_divergence_of_nothing(spark, edge):
    assert source_divergence.divergences(edge.limit(0)).count() == 0
    assert {(r.part, r.value) for r in source_divergence.divergences(edge).collect()} == {("pair", 0)}  # no term in 30 documents


def test_divergence_does_not_trust_hashes(spark, monkeypatch):
    data = np.frombuffer("ab cd ab ef Ab ab".encode(), np.uint8)
    monkeypatch.setattr(source_divergence.xxhash, "xxh3_64_intdigest", lambda b: 7)
    term, g, n, docs = source_divergence.slice_counts(data, np.array([0, 8, 8, 17]), np.array([0, 1, 1]), 2)
    assert sorted(zip(term.to_pylist(), g.tolist(), n.tolist(), docs.tolist(), strict=True)) == [("ab", 0, 2, 1), ("ab", 1, 2, 1), ("cd", 0, 1, 1), ("ef", 1, 1, 1)]


def test_shares_are_exact():
    rng = random.Random(1)
    of = [rng.randint(1, 2**63 // 1000) for _ in range(200)]
    count = [rng.randint(0, x) for x in of]
    assert source_divergence.share(np.array(count), np.array(of)).tolist() == [1 + 10**9 * c // x for c, x in zip(count, of, strict=True)]


# ---------------------------------------------------------------- quality rules


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return dict(
        n_words=len(words), word_chars=sum(map(len, words)), n_symbols=len(re.findall(r"[#*$%&|<>]", text)), n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(hit), n_lines=len(lines), n_chars=len(text),
        n_letters=len(re.findall(r"[A-Za-z]|[^\x00-\x7F]", text)), n_capitals=len(re.findall("[A-Z]", text)), n_shouts=text.count("!"), n_echoes=sum(a == b for a, b in zip(words, words[1:])),
        n_ended_lines=sum(bool(re.search(r"[.!?][\x20\x09-\x0D]*\Z", x)) for x in lines),
    )


def test_measures_against_brute_force(spark, edge):
    rng = random.Random(4)
    piece = ["a", "b", "c", "é", "# ", "!", ".", " ", "  ", "\n", "\t", "\x0b", "\r\n", "日本 ", " ", "a b c d e "]
    rows = [(i, "".join(rng.choices(piece, k=rng.randint(0, 120)))) for i in range(150)] + [(900, "x " * 70_000), (901, "line one.\nline one.\n\nline one.")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    for docs, want in ((d, rows), (edge, [r[:2] for r in edge_rows()])):
        got = Counter(tuple(r) for r in quality_rules.measures(docs).collect())
        assert got == Counter((i, *(brute_measures(t)[c] for c in quality_rules.COUNTS)) for i, t in want)


def test_window_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(quality_rules, "mix64", lambda x: x * np.uint64(0))
    text = "a b c d e f a b c d e g h"
    found = quality_rules.counted(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert found["n_repeat_words"].tolist() == [10]


def test_estimated_accuracies():
    rng = np.random.default_rng(6)
    good = rng.random(40_000) < 0.8
    right, caught, says = [0.95, 0.9, 0.99, 0.85, 0.97], [0.8, 0.6, 0.7, 0.9, 0.5], [0.9, 1.0, 0.6, 0.8, 1.0]
    cast = [np.where(rng.random(40_000) < s, np.where(good, np.where(rng.random(40_000) < a, 1, -1), np.where(rng.random(40_000) < b, -1, 1)), 0) for a, b, s in zip(right, caught, says, strict=True)]
    patterns, n = np.unique(np.stack(cast, axis=1), axis=0, return_counts=True)
    share, a, b, post = quality_rules.estimate(patterns, n.astype(float), 200)
    assert abs(share - 0.8) < 0.03 and np.abs(a - right).max() < 0.03 and np.abs(b - caught).max() < 0.08
    assert post[(patterns == 1).all(axis=1)][0] > 0.99 > 0.05 > post[(patterns == -1).all(axis=1)][0]


def test_quality_against_labels(spark, sf01):
    got = quality_rules.op12_quality_rules(spark, sf01).join(table(spark, sf01, "labels"), "doc_id").toPandas()
    clean = got[(got.quality == 1) & ~got.base_failed]
    assert clean.kept.mean() > 0.98 and got[got.quality == 0].kept.mean() < 0.1
    objected = quality_rules.measures(table(spark, sf01, "documents")).select("doc_id", F.array_contains(F.array(*quality_rules.votes()), -1).alias("objected")).toPandas()
    assert clean.merge(objected, on="doc_id").objected.mean() > 1 - clean.kept.mean()  # all-must-pass would lose more


def test_quality_cases(spark, edge):
    got = quality_rules.judged(quality_rules.measures(edge)).collect()
    assert len(got) == len(edge_rows()) and not any(r.kept for r in got if r.n_words < 10)
    assert quality_rules.judged(quality_rules.measures(edge.limit(0))).count() == 0
    with pytest.raises(ValueError):
        quality_rules.judged(quality_rules.measures(edge), {f"r{i}": ("n_words < 1", "n_words > 1") for i in range(12)})


# ---------------------------------------------------------------- fill in the middle


def brute_form(doc_id, units):
    text = "".join(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


CUTS = {"character": list, "word": lambda t: re.findall(r"\s*\S+\s*\Z|\s*\S+|\s+\Z", t, re.A), "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+\Z", t)}


@pytest.mark.parametrize("unit", sorted(CUTS))
def test_forms_against_brute_force(spark, unit):
    rng = random.Random(len(unit))
    piece = ["a", "é", "日", "😀", "\x1b", "\x1f", "\x1be", "\x1bc", "\n", "\r\n", " ", "<", "<S", "P>", "$1", "\\", " ", "word "]
    rows = [(i, "".join(rng.choices(piece, k=rng.randint(0, 12)))) for i in range(300)] + [(None, "null id"), (7, "<P> marked"), (8, "a<S>"), (9, "<M>"), (10, None), (11, ""), (12, LONG), (12, LONG), (-5, "minus")]
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, form string, n int")
    out = fill_middle.fill_in_middle(d, unit=unit)
    out = out.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((i, *brute_form(i, CUTS[unit](t or ""))) for i, t in rows)
    got = Counter((r.doc_id, r.n, r.form, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), r.output) for r in out)
    assert got == want and all(r.again == r.text for r in out)
    assert fill_middle.fill_in_middle(d.limit(0)).count() == 0
