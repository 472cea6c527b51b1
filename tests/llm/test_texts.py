"""Repeated strings, toxicity, top-k, token counts, the Jaccard join, the token store and the pipeline."""

import hashlib
import math
import os
import random
import re
import shutil
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

import pytest
from pyspark.sql import functions as F

from terrapanel.llm import induced, jaccard_join, suffix_dedup, token_count, token_store, topk, toxicity
from terrapanel.llm.queries import QUERIES

from .test_filters import DOCS, edge_rows


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


# ---------------------------------------------------------------- suffix arrays


def test_induced_sorting_against_sorted_suffixes():
    rng = random.Random(5)
    for _ in range(250):
        n, a, depth = rng.randint(1, 60), rng.choice([1, 2, 3, 10]), rng.choice([3, 5, 50])
        t = [rng.randint(1, a) for _ in range(n)] + [0]
        blocks = induced.sorted_suffixes(np.array(t, np.int64), depth, rng.choice([4, 50, 10**6]), rng.choice([1, 5, 10**6]))
        got = np.concatenate([*blocks, np.empty(0, induced.ROW)]).tolist()
        want = sorted(range(n), key=lambda i: t[i:])
        assert sorted(p for p, _ in got) == list(range(n))
        before = None
        for (p, shared), w in zip(got, want, strict=True):
            assert t[p : p + depth] == t[w : w + depth]
            if before is not None:
                k = 0
                while k < depth and p + k <= n and before + k <= n and t[p + k] == t[before + k]:
                    k += 1
                assert k == shared
            before = p


def brute_repeats(rows, length=50):
    """(n_bytes, removed ranges, kept) of (doc_id, text) rows."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        if i is not None:
            for s in range(len(b) - length + 1):
                w = b[s : s + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1) if i is not None else ():
            if first.get(b[s : s + length], i) < i:
                gone[s : s + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((i, len(b), edge[::2].tolist(), edge[1::2].tolist(), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)


def test_repeats_against_brute_force(spark, edge, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(25)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        rows.append((i // 2 if i % 9 == 0 else i, parts[0] + rng.choice(passages) + parts[1] + rng.choice(passages)[: rng.randint(0, 120)] + parts[2]))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (3, rows[3][1]), (None, rows[3][1]), (202, "a" * 300), (203, "b" + "a" * 120), (204, "ab" * 90), (205, "ba" * 70), (206, ""), (207, None), (208, "short")]
    df = spark.createDataFrame([(i, t, 5, "x", "y") for i, t in rows], "doc_id long, text string, shard int, payload string, bucket string")
    for size, hot in ((2000, 20_000), (10**6, 20_000), (2000, 0)):
        got = sorted(((r.doc_id, r.n_bytes, list(r.removed_from), list(r.removed_to), bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, shard_bytes=size, content_bytes=size, hot=hot).collect()), key=str)
        assert got == brute_repeats(rows)
    got = sorted(((r.doc_id, r.n_bytes, list(r.removed_from), list(r.removed_to), bytes(r.kept)) for r in suffix_dedup.remove_repeats(edge).collect()), key=str)
    assert [g[0] for g in got] == [g[0] for g in brute_repeats([(r[0], r[1]) for r in edge_rows() if len(r[1] or "") < 1000] + [(4, "x")])] and len(got) == len(edge_rows())
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_one_anchor_in_half_of_all_documents(spark):
    """A menu line in ever other surroundings is split over the content shards, and the result is the same."""
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, tail = "Home | About | Contact | Imprint", " | a footer of sixty bytes that stands below many of the pages"
    rows = [(i, noise(60) + (line + rng.choice(["", tail[: rng.randint(10, 62)]]) if i % 2 else "") + noise(40)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows)
    for hot in (5, 20_000):
        got = sorted(((r.doc_id, r.n_bytes, list(r.removed_from), list(r.removed_to), bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, shard_bytes=10**4, content_bytes=10**4, hot=hot).collect()), key=str)
        assert got == want and any(r[2] for r in got)


def test_content_shard_is_sorted_at_anchors_only():
    """Least ids of all strings like a dictionary's, without a step a byte of the snippets."""
    rng = random.Random(12)
    half = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    rows, first = [], {}
    for g in range(400):
        gram, fronts, backs = rng.randbytes(20), [half(30) for _ in range(6)], [half(30) for _ in range(6)]
        for _ in range(100):
            lead = rng.randint(0, 30)
            text = (rng.choice(fronts)[30 - lead :] + gram + rng.choice(backs))[: 49 + rng.randint(1, lead + 1)]
            low = rng.randint(0, 10**6)
            rows.append((g, lead, text, low, low + rng.randint(0, 10**5)))
            for k in range(len(text) - 49):
                key = (g, text[k : k + 50])
                first[key] = min(first.get(key, low), low)
    g, lead, text, low, high = zip(*rows, strict=True)
    name = [hash((a, b)) for a, b in zip(g, text, strict=True)]
    n, kinds = len(rows), {"long": pa.int64(), "int": pa.int32(), "byte": pa.int8(), "binary": pa.binary()}
    given = {"bucket": [0] * n, "shard": [7] * n, "run": range(n), "skip": [0] * n, "lead": lead, "name": name, "anchor": [a * 10**12 for a in g], "least": low, "most": high, "text": text}
    whole = pa.table({c: pa.array(list(given[c]), kinds[k]) for c, k in (x.split() for x in suffix_dedup.SNIPPETS.split(", "))})
    began = time.process_time()
    got = suffix_dedup.compare(whole).to_pylist()
    assert time.process_time() - began < 2
    seen = {(r["run"], k): r["least"] for r in got for k in range(r["start"], r["stop"])}
    want = {(i, k): first[g[i], text[i][k : k + 50]] for i in range(n) for k in range(len(text[i]) - 49)}
    assert seen == {at: least for at, least in want.items() if least < high[at[0]]}


def test_shard_larger_than_memory():
    """Recursion with all of its state on disk, on a text of many times ``memory`` rows."""
    rng = np.random.default_rng(3)
    base = rng.integers(1, 6, 20_000)
    text = np.concatenate([base, rng.integers(1, 6, 5000), base[:15_000], [0]])
    blocks = list(induced.sorted_suffixes(text, 50, memory=500, internal=10))
    place = np.concatenate([b["place"] for b in blocks])
    raw = text.astype(np.uint8).tobytes()
    assert sorted(place.tolist()) == list(range(len(text) - 1))
    keys = [raw[p : p + 50] for p in place.tolist()]
    assert all(a <= b for a, b in zip(keys[:-1], keys[1:], strict=True))
    shared = np.concatenate([b["shared"] for b in blocks])
    assert all(os.path.commonprefix([a, b]).__len__() == s for a, b, s in zip(keys[:-1], keys[1:], shared[1:].tolist(), strict=True) if s)


def test_repeats_query(spark, sf001):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op3_suffix_array_dedup"](spark, sf001).collect()}
    for i, n, a, b, kept in brute_repeats(rows):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, sum(b) - sum(a), len(a), hashlib.sha256(kept).hexdigest())


# ---------------------------------------------------------------- toxicity


def test_toxicity_holds_out(spark, sf01):
    got = QUERIES["op4_toxicity"](spark, sf01).toPandas().merge(spark.read.parquet(f"{sf01}/labels.parquet").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    out = got[got.held_out]
    hit = out[out.predicted == 1]
    assert hit.toxic.mean() > 0.9 and (out[out.toxic == 1].predicted == 1).mean() > 0.6


def brute_toxicity(rows, labels, k):
    """Scores, neighbours and cosines of (doc_id, text) rows from raw texts, with the labels {doc_id: toxic}."""
    words = lambda t: Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    texts = {}
    for i, t in rows:
        if i in labels and words(t):
            texts.setdefault(t, []).append(i)
    held = sorted((min(ids), words(t), sum(labels[i] for i in ids) / len(ids) >= 0.5) for t, ids in texts.items())
    n, df, toxic = len(held), Counter(), Counter()
    for _, w, y in held:
        df.update(w.keys())
        toxic.update(w.keys() if y else ())

    def vector(w):
        v = {t: (1 + math.log(c)) * math.log1p(n / max(1, df[t])) * math.log2(2 + toxic[t] / max(1, df[t] - toxic[t])) for t, c in w.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    known, base = [(i, vector(w), y) for i, w, y in held], sum(y for *_, y in held) / max(1, n)

    def near(w, own=None):
        v = vector(w) if w else {}
        found = [(round(sum(x * e[t] for t, x in v.items() if t in e), 6), i, y) for i, e, y in known if i != own]
        found = sorted(((c, i, y) for c, i, y in found if c > 0), key=lambda f: (-f[0], f[1]))[:k]
        vote = (sum(c for c, _, y in found if y) + toxicity.PRIOR * base) / (sum(c for c, *_ in found) + toxicity.PRIOR)
        return vote, found

    a, b = toxicity.logistic(np.array([near(w, i)[0] for i, w, _ in held]), np.array([float(y) for *_, y in held]))
    out = []
    for i, t in rows:
        vote, found = near(words(t))
        out.append((i, 1 / (1 + math.exp(-a - b * vote)) if found else base, [f[1] for f in found], [f[0] for f in found]))
    return out


@pytest.mark.parametrize(("long", "block"), [(512, 64), (5, 4), (0, 3)])
def test_toxicity_against_brute_force(spark, sf001, long, block):
    """Terms, weights, cosines, votes and scores from raw texts, whatever lists are stored by block."""
    docs, labels = spark.read.parquet(f"{sf001}/documents.parquet"), spark.read.parquet(f"{sf001}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()] + [(900, "unheardofword"), (901, None), (902, "the of und"), (903, "idiot " * 40_000)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    usable = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    model = toxicity.fit(docs, labels, toxicity.unheld, k=7, long=long, block=block)
    got = {r.doc_id: r for r in toxicity.score(more, model).collect()}
    for i, score, ids, cosines in brute_toxicity(rows, usable, 7):
        assert got[i].score == pytest.approx(score, abs=2e-3), i
        assert len(got[i].cosines) == len(cosines) and np.allclose(got[i].cosines, cosines, atol=2e-5)
        # neighbours may change places only where their cosines are equal in single precision
        assert all(x == y or abs(c - d) < 2e-5 for x, y, c, d in zip(got[i].neighbours, ids, got[i].cosines, cosines, strict=True))


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(10))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert [len(toxicity.fit(docs, labels, limit=limit, postings=postings).index.value.ids) for limit, postings in ((15, 1000), (40, 95), (40, 1000))] == [15, 9, 40]


def test_toxicity_ties_and_repeats(spark):
    docs = spark.createDataFrame([(i, f"common word{i}") for i in range(1, 9)] + [(3, "common word3"), (9, "common word1")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 10)], "doc_id long, toxic int")
    got = toxicity.score(docs.select("doc_id", F.lit("common").alias("text")), toxicity.fit(docs, labels)).collect()
    assert len(got) == 10 and all(list(r.neighbours) == list(range(1, 9)) for r in got)


def test_toxicity_cases(spark, edge):
    labels = spark.createDataFrame([(1, 0, 1), (2, None, None), (None, 1, 1), (5, 0, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        model = toxicity.fit(edge, lab)
        got = toxicity.score(edge, model).collect()
        assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
        kept = toxicity.reject(edge, model)
        assert kept.columns == edge.columns and kept.count() <= len(edge_rows())
    assert toxicity.score(edge.limit(0), model).count() == 0 and toxicity.reject(edge.limit(0), model).count() == 0


# ---------------------------------------------------------------- top k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.choice([-0.5, 0.0, 0.25, 0.7], 8).tolist()) for i in range(0, 400, 4)] + [(401, None), (402, [1.0, None]), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (None, [1.0] * 8), (405, [0.3, -0.2]), (406, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, shard string, q int")
    v = topk.quantised(df)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v.where("vec_id % 100 = 0"), v).collect())
    use = {i: np.array([math.floor(1024 * x) for x in e] + [0] * (8 - len(e))) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for q in (0, 100, 200, 300):
        best = sorted((-int(use[q] @ w), i) for i, w in use.items() if i != q)[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.top_k(v.limit(0), v).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0
    assert topk.top_k(v.where("vec_id in (0, 4)"), v.where("vec_id in (0, 4)")).count() == 2


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.choice([-3e4, 1.5e5, 2e5, 2e5 + 1 / 1024], 6)] + [float(rng.integers(-2, 3)) * (i % 3), 0.0]) for i in range(300)]
    for i in range(300, 400):  # no long holds their components; most have scores far below all others
        rows.append((i, [0.0] * 6 + [-1e14 * (i % 7), 1e30]))
    for q in (0, 100, 200):
        rows[q][1][6] = 0.5
    rows[300] = (300, [1.0, 2.0, -1.0, 0.5, 0.0, 0.0, 0.25, 0.0])
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v.where("vec_id % 100 = 0"), v).collect())
    use = {i: [math.floor(1024 * x) for x in e] for i, e in rows}
    want = []
    for q in (0, 100, 200, 300):
        best = sorted((-sum(a * b for a, b in zip(use[q], w, strict=True)), i) for i, w in use.items() if i != q)[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


# ---------------------------------------------------------------- token counts


def brute_pieces(texts):
    """Piece scores from the library's segmentation of every word."""
    sp = token_count.processor(token_count.vocabulary_path())
    ordinary = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    m, counts = token_count.MAX_WORD, Counter()
    for t in texts:
        for w in (t or "").split():
            for a in range(0, len(w), m):
                counts.update(sp.encode(w[a : a + m]))
    total = sum(counts[i] + 1 for i in ordinary)
    return {sp.id_to_piece(i): math.log((counts[i] + 1) / total) for i in ordinary}


def brute_tokens(word, pieces):
    """(tokens, unknown characters) of a word without a trie."""
    word = token_count.MARK + word
    best = [(0.0, 0, 0)]
    for i in range(1, len(word) + 1):
        s, n, u = best[i - 1]
        options = [(s + token_count.UNKNOWN, -(n + len(word[i - 1].encode())), -(u + 1))]
        for j in range(max(0, i - 40), i):
            if word[j:i] in pieces:
                options.append((pieces[word[j:i]] + best[j][0], -(best[j][1] + 1), -best[j][2]))
        top = max(options, key=lambda o: (o[0], o[1]))
        best.append((top[0], -top[1], -top[2]))
    return best[-1][1], best[-1][2]


@pytest.mark.parametrize("shared", [1, 100, 1_500_000])
def test_token_counts_against_brute_force(spark, edge, sf001, shared):
    docs = edge.select("doc_id", "text", "tokens").unionByName(spark.read.parquet(f"{sf001}/documents.parquet").limit(20).select("doc_id", "text", F.lit("t").alias("tokens")))
    docs = docs.unionByName(spark.createDataFrame([(77, "longword" * 400 + " x", "t"), (78, "漢字" * 300, "t"), (79, "a" * 257, "t")], "doc_id long, text string, tokens string"))
    pieces, known = brute_pieces([r.text for r in docs.collect()]), {}

    def count(text):
        words = (text or "").split()
        for w in set(words) - set(known):
            known[w] = brute_tokens(w, pieces)
        return len(words), sum(known[w][0] for w in words), sum(known[w][1] for w in words)

    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    model = token_count.fit(docs, shared=shared)
    assert model.value.pieces == pytest.approx(pieces) and len(model.value.terminal) <= shared
    assert sorted(map(tuple, token_count.count_tokens(docs, model).collect()), key=key) == sorted(((r.doc_id, *count(r.text)) for r in docs.collect()), key=key)
    assert token_count.count_tokens(docs.limit(0), token_count.fit(docs.limit(0))).count() == 0


def test_full_trie_is_emptied():
    trie = token_count.ForwardTrie({"▁ab": -1.0, "c": -2.0}, max_nodes=3)
    assert [trie.tokens(w) for w in ("abc", "abc", "zz", "abcc")] == [(2, 0), (2, 0), brute_tokens("zz", trie.pieces), (3, 0)]


def test_long_word_takes_no_nodes():
    trie = token_count.ForwardTrie({"▁a": -1.0, "ab": -1.5, "bab": -2.0, "b": -1.7})
    word = "ab" * 1_000_000
    assert trie.tokens(word)[1] == 0 and len(trie.score) == 1 and not trie.terminal
    assert trie.tokens(word[:3000]) == brute_tokens(word[:3000], trie.pieces)


# ---------------------------------------------------------------- Jaccard join


def brute_classes(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        if i is not None:
            s = frozenset(jaccard_join.text_set(t).tolist())
            sets[i] = s
    label = {i: i for i in sets}
    classes = {}
    for i, s in sets.items():
        classes.setdefault(s if s else ("empty", i), []).append(i)
    reps = {s: min(m) for s, m in classes.items()}
    links = {r: 0 for r in reps.values()}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    items = [(s, r) for s, r in reps.items() if isinstance(s, frozenset)]
    for a in range(len(items)):
        for b in range(a + 1, len(items)):
            (s, i), (t, j) = items[a], items[b]
            n = len(s & t)
            if n >= threshold * (len(s) + len(t) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {i: (root(reps[s if s else ("empty", i)]), reps[s if s else ("empty", i)], len(classes[s if s else ("empty", i)]), links[reps[s if s else ("empty", i)]]) for i, s in sets.items()}


def test_jaccard_join_against_all_pairs(spark, sf001):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_copies, r.n_links) for r in QUERIES["op7_ngram_jaccard_join"](spark, sf001).collect()}
    assert got == brute_classes(rows)


def test_jaccard_join_cases(spark, edge):
    rng = random.Random(3)
    base = [f"v{rng.randint(0, 999)}" for _ in range(120)]
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (10, 60, 110)]
    rows = [(10, " ".join(base)), (11, " ".join(base).upper()), *((20 + k, t) for k, t in enumerate(near)), (30, "one two"), (31, "One, two!"), (32, "one two three"), (40, ""), (41, None), (None, " ".join(base)), (10, " ".join(base))]
    df = spark.createDataFrame([(*r, 3, "z") for r in rows], "doc_id long, text string, component int, node string")
    got = jaccard_join.near_links(df).collect()
    ids = {r.doc_id: (r.class_id, r.copy_id, r.n_copies, r.n_links) for r in got if r.doc_id is not None}
    assert ids == brute_classes(rows) and len(got) == len(ids) + 1
    kept = jaccard_join.without_near_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 10, 30, 32, 40, 41]
    assert jaccard_join.near_links(edge).count() == len({r[0] for r in edge_rows()})
    assert jaccard_join.near_links(df.limit(0)).count() == 0 and jaccard_join.without_near_copies(df.limit(0)).count() == 0


def test_one_id_with_several_texts(spark):
    rng = random.Random(5)
    a, b = ([f"{c}{rng.randint(0, 999)}" for _ in range(120)] for c in "ab")
    near = lambda w: " ".join([*w[:60], "changed", *w[61:]])
    rows = [(3, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (7, near(b)), (2, " ".join(f"c{i}" for i in range(90))), (2, near([f"c{i}" for i in range(90)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.copy_id, r.n_copies, r.n_links) for r in jaccard_join.near_links(df).collect())
    assert got == [(2, 2, 2, 1, 1), (2, 2, 2, 1, 1), (3, 3, 3, 2, 0), (5, 3, 3, 2, 0), (5, 5, 5, 1, 1), (7, 5, 7, 1, 1)]
    kept = [(r.doc_id, r.text) for r in jaccard_join.without_near_copies(df).collect()]
    assert sorted(i for i, _ in kept) == [2, 3, 5] and rows[0] in kept and rows[2] in kept


def test_large_component_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else f"x{rng.randint(0, 99)}" for w in base)) for i in range(90)]
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_copies, r.n_links) for r in jaccard_join.near_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert {i: g[1:3] for i, g in got.items()} == {i: w[1:3] for i, w in want.items()}
    # pairs at the threshold itself may miss every band: hardly any link is lost
    assert sum(g[3] for g in got.values()) >= 0.99 * sum(w[3] for w in want.values())


def test_banding_meets_its_recall():
    for threshold in (0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0):
        for recall in (0.9, 0.99, 0.999):
            bands, rows = jaccard_join.banding(threshold, recall)
            assert 1 - (1 - threshold**rows) ** bands >= recall - 1e-9
    assert jaccard_join.banding(0.8) == (23, 6)
    with pytest.raises(ValueError):
        jaccard_join.banding(0.001, 0.999)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8])
def test_recall_at_thresholds(spark, threshold):
    """Pairs a little over each threshold are found, against all pairs."""
    rng = random.Random(11)
    rows = []
    for i in range(120):
        base = [f"g{i}w{rng.randint(0, 10**6)}" for _ in range(150)]
        other, goal = list(base), threshold + 0.02
        k = rng.randint(0, 20)  # a changed word every so often breaks five n-grams
        while len({tuple(base[j : j + 5]) for j in range(146)} & {tuple(other[j : j + 5]) for j in range(146)}) / (292 - len({tuple(base[j : j + 5]) for j in range(146)} & {tuple(other[j : j + 5]) for j in range(146)})) > goal + 0.05:
            other[k % 150] = f"x{rng.randint(0, 10**6)}"
            k += rng.randint(5, 17)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    want = brute_classes(rows, threshold)
    got = {r.doc_id: r.n_links for r in jaccard_join.near_links(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold).collect()}
    assert sum(w[3] for w in want.values()) > 100
    assert sum(min(got[i], w[3]) for i, w in want.items()) >= 0.98 * sum(w[3] for w in want.values()) and all(got[i] <= w[3] for i, w in want.items())


def test_chained_buckets_are_compared_bucket_by_bucket(spark, monkeypatch):
    """A sliding text ties many documents into one component whose far ends are unlike."""
    words = [f"s{i}" for i in range(900)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 120])) for i in range(150)]
    df, groups = spark.createDataFrame(rows, "doc_id long, text string"), []
    monkeypatch.setattr(jaccard_join, "_groups", lambda reps, own=jaccard_join._groups: groups.append(own(reps)) or groups[0])
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_copies, r.n_links) for r in jaccard_join.near_links(df).collect()}
    assert got == brute_classes(rows)
    assert max(r.n for r in groups[0].select(F.size("at").alias("n")).collect()) > 1  # buckets, not the component
    assert max(r["count"] for r in groups[0].select(F.explode("at")).groupBy("col.gid").count().collect()) < 20


# ---------------------------------------------------------------- token store


def test_token_store_round_trip(spark, edge, sf001):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_store.vocabulary_path())
    odd = ["don't we'll I'VE  two  spaces\n\n\ttabs ", "日本語 テキスト 한국어", "à ​ \U0001f600 ½ ٣٤", "<|endoftext|> x </s>", " " * 50, "x" * 5000, "  z　"]
    docs = edge.select("doc_id", "text", "key").unionByName(spark.read.parquet(f"{sf001}/documents.parquet").where("doc_id >= 10").select("doc_id", "text", F.lit(1).alias("key")))
    docs = docs.unionByName(spark.createDataFrame([(1000 + i, t, 1) for i, t in enumerate(odd)], "doc_id long, text string, key long"))
    got = token_store.store_and_verify(docs).collect()
    want = sorted(((r.doc_id, [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    got = sorted(got, key=lambda r: r.start)
    assert all(r.intact for r in got) and [r.doc_id for r in got] == [w[0] for w in want]
    start = 0
    for r, (_, ids) in zip(got, want, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_cut_texts_give_the_library_s_ids():
    """Random strings around every kind of boundary, documents side by side in one slice."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from terrapanel.llm.bytetext import slices, utf8

    tok, enc = Tokenizer.from_file(token_store.vocabulary_path()), token_store.Encoder(token_store.vocabulary_path())
    parts = ["a", "B", "zz", "é", "日", "1", "９", " ", "  ", "\n", "\t", "\r\n", "\u2003", "\u3000", "\xa0", ".", ",", "'s", "'ll", "'", "-", "_", "<|endoftext|>", "<|", "😀", "\x85", "ß", "½", "`", "\x1c", "x", "long" * 30]
    rng = random.Random(3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    data, offsets = utf8(pa.array(texts))
    for i, j in slices(offsets, 1 << 14):
        ids, at = enc.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k in range(i, j):
            assert ids[at[k - i] : at[k - i + 1]].tolist() == [*tok.encode(texts[k], add_special_tokens=False).ids, token_store.END_ID], texts[k]


def test_token_store_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the same passage again and again " * 200 + str(i % 3)) for i in range(9)], "doc_id long, text string")
    path = str(tmp_path / "store")
    token_store.write_store(docs, path)
    ids = {r.doc_id: list(r.ids) for r in token_store.read_documents(spark, path).collect()}
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_store.vocabulary_path())
    assert all(ids[r.doc_id] == [*tok.encode(r.text, add_special_tokens=False).ids, 2] for r in docs.collect())
    chunks = spark.read.parquet(f"{path}/data").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count() < spark.read.parquet(f"{path}/segments").agg(F.sum("n_chunks")).first()[0]
    root = token_store.store_root(spark, path)
    other = str(tmp_path / "other")
    token_store.write_store(docs.where("doc_id < 8"), other)
    assert len(root) == 64 and token_store.store_root(spark, other) != root


def test_token_store_notices_changed_recipes(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"passage {i} " * 40) for i in range(9)], "doc_id long, text string")
    store = str(tmp_path / "store")
    token_store.write_store(docs, store)
    good = spark.read.parquet(f"{store}/segments").toPandas()
    schema = spark.read.parquet(f"{store}/segments").schema
    swapped = good.copy()
    names = ["names", "root", "n", "n_chunks"]
    swapped.loc[swapped.doc_id == 3, names] = good.loc[good.doc_id == 4, names].to_numpy()  # whole in itself
    changed = {"lost": good[good.doc_id != 3], "repeated": good.loc[[*good.index, good.index[good.doc_id == 3][0]]], "swapped": swapped}
    for name, rows in changed.items():
        other = str(tmp_path / name)
        shutil.copytree(store, other)
        shutil.rmtree(f"{other}/segments")
        spark.createDataFrame(rows, schema).write.parquet(f"{other}/segments")
        got = token_store.verify_store(spark, other).collect()
        own = {r.doc_id: r.segment for r in rows.itertuples()}
        bad = good.loc[good.doc_id == 3, "segment"].iloc[0]
        assert len(got) == len(rows) + (name == "lost"), name
        assert all(not r.intact for r in got if r.doc_id is None or own[r.doc_id] == bad) and any(not r.intact for r in got), name
    assert all(r.intact for r in token_store.verify_store(spark, store).collect())
    spark.createDataFrame([("0" * 64,)], "root string").write.mode("overwrite").parquet(f"{store}/root")
    assert not any(r.intact for r in token_store.verify_store(spark, store).collect())


def test_token_store_empty(spark, edge):
    assert token_store.store_and_verify(edge.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, sf001):
    import corpus_pipeline as pipe

    from terrapanel.llm import decontaminate, mixing
    from terrapanel.llm.tables import saved

    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stages = dict(pipe.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "source_mixing", "token_store"]
    one = saved(stages["toxicity"](spark, docs, sf001), "t")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf001}/labels.parquet"), toxicity.unheld)).collect()}
    assert one.columns == docs.columns and ids(one) == sorted(i for i, s in scores.items() if s < toxicity.CUT)
    two = saved(stages["near_duplicates"](spark, one, sf001), "t")
    classes = brute_classes([(r.doc_id, r.text) for r in one.collect()])
    assert two.columns == docs.columns and ids(two) == sorted({c[0] for c in classes.values()})
    three = saved(stages["decontamination"](spark, two, sf001), "t")
    bad = {r.doc_id for r in decontaminate.judged(decontaminate.hit_spans(two, spark.read.parquet(f"{sf001}/benchmark.parquet"))).where("contaminated").collect()}
    assert three.columns == docs.columns and ids(three) == sorted(set(ids(two)) - bad)
    four = saved(stages["source_mixing"](spark, three, sf001), "t")
    rows = mixing.light(three)
    assert four.columns == docs.columns and ids(four) == ids(mixing.copies(rows, mixing.mix_plan(rows)))
    five = stages["token_store"](spark, four, sf001)
    assert ids(five) == ids(four) and five.where("not intact").count() == 0


def test_pipeline_cases(spark, edge, sf001):
    import corpus_pipeline as pipe

    for docs in (edge, edge.limit(0)):
        for name, stage in pipe.STAGES:
            out = stage(spark, docs, sf001)
            assert name == "token_store" or out.columns == docs.columns
            n = out.count()
            assert (n == 0) == (docs.count() == 0)


def test_an_overlong_example_is_passed_over(spark):
    texts = [(i, f"word{i} common other{i % 7}") for i in range(40)] + [(1000, " ".join(f"x{k}" for k in range(500)))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts] + [(5000 + i, 1) for i in range(200)], "doc_id long, toxic int")
    got = toxicity.examples(docs, labels, lambda c: F.lit(True), 41, 300, "doc_id", "text").collect()
    assert {r.doc_id for r in got} == set(range(40))  # neither the long text nor labels without a document take their place


def test_repeated_rows_meet_once(spark):
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    rows = [(1, " ".join(words))] * 3000 + [(2, " ".join([*words[:-1], "other"]))]
    got = jaccard_join.near_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(1, 1, 1), (2, 1, 1)]


def test_reading_a_store_gives_encoders_back(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(40)], "doc_id long, text string")
    path = token_store.scratch(spark, "store-to-read")
    token_store.write_store(docs, path)

    class Read:
        """Stands for the chunks' table; keeps the function that tasks run."""

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    read = Read()
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, schema: read.mapInArrow(run, schema))
    token_store.chunk_sums(spark, path)
    token_store._encoders["kept"] = object()
    assert not list(read.run(iter([]))) and not token_store._encoders
