"""Exact top-k search, periodic runs and the divergence of sources against plain versions, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitwarden.llm import divergence, periodic, topk

from .brute import WORD

CLASHING = ("row", "shard", "v", "rank", "score", "t", "slice", "term", "value", "n", "part", "item", "start", "length", "period", "dims", "leaf")


def awkward(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


# ---- 11 ----


def plain_top_k(rows, k, scale=1024.0):
    """Sorted (query_id, rank, vec_id, score) of (vec_id, vector, asks) rows, in whole numbers."""
    live = []
    for n, (key, vector, asks) in enumerate(rows):
        if vector is None or any(x is None or not math.isfinite(x) or not math.isfinite(x * scale) for x in vector):
            continue
        live.append((n, key, [math.floor(x * scale) for x in vector], asks))
    out = []
    for n, key, vector, asks in live:
        if asks:
            hits = [(-sum(a * b for a, b in zip(vector, v)), i is None, i or 0, m) for m, i, v, _ in live if m != n and len(v) == len(vector)]
            for place, (s, gone, i, _) in enumerate(sorted(hits)[:k]):
                out.append((key, place + 1, None if gone else i, max(-(2**63) + 1, min(2**63 - 1, -s))))
    return sorted(out, key=str)


def found_top_k(spark, rows, k, **sizes):
    df = awkward(spark.createDataFrame(rows, "vec_id long, embedding array<double>, asks boolean"))
    got = topk.top_k(df, F.col("asks"), k=k, **sizes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("spread", [0.02, 5.0])
def test_top_k_matches_all_scores(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5)) * spread
    rows = [(i, (centres[rng.integers(6)] + rng.normal(size=5) / 20).tolist(), i % 20 == 0) for i in range(700)]
    rows += [(1000 + i, rows[0][1], i % 100 == 0) for i in range(300)]  # a third of the rows hold one vector
    assert found_top_k(spark, rows, 10, shard_rows=(64, 128), leaf_rows=16) == plain_top_k(rows, 10)


def test_top_k_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, -0.25], True), (1, [0.5, -0.25], True), (2, [0.5, None], True), (3, None, True), (4, [nan, 1.0], True), (5, [inf, 1.0], True),
        (6, [1e307, 1.0], True), (7, [], True), (8, [], False), (None, [0.5, 0.5], True), (None, [0.5, 0.5], False), (9, [-0.0001, 0.0], False), (10, [1.0, 2.0, 3.0], True),
        (11, [1e30, -1e30, 2.0], True), (12, [1e30, 1e30, 1.0], False)
    ]
    got = found_top_k(spark, rows, 10)
    assert got == plain_top_k(rows, 10)
    assert {r[0] for r in got} == {1, 7, None, 10, 11}
    assert found_top_k(spark, [], 10) == []
    assert found_top_k(spark, [(1, [1.0], True)], 10) == []  # alone


def test_a_nearby_k_th_score_saves_leaves():
    rng = np.random.default_rng(5)
    x = np.floor(1024 * (rng.normal(size=(32, 8))[rng.integers(0, 32, 4096)] + rng.normal(size=(4096, 8)) / 50))
    tree = topk.Tree([(r.tolist(), r.tolist(), x[r]) for r in topk.median_splits(x, 64)])
    read = Counter()

    class Seen(list):
        def __getitem__(self, k):
            read[k] += 1
            return super().__getitem__(k)

    tree.leaves = Seen(tree.leaves)
    q = x[rng.permutation(4096)[:50]]
    first = tree.search(q, [-1] * 50, 10, [-math.inf] * 50)
    begun = sum(read.values())
    read.clear()
    again = tree.search(q, [-1] * 50, 10, [min(h)[0] for h in first])
    assert [sorted(h) for h in again] == [sorted(h) for h in first]
    assert sum(read.values()) <= begun < 50 * len(tree.leaves) / 2  # most leaves are never looked at


def test_median_splits_halve():
    x = np.random.default_rng(2).integers(0, 3, (1000, 4)).astype(float)
    leaves = topk.median_splits(x, 64)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(1000))
    assert len(leaves) == 16 and {len(r) for r in leaves} <= {62, 63}


# ---- 12 ----


def plain_runs(words, least):
    """(start, length, period) by looking along every period."""
    out, n = [], len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            size = i + p - s
            if size >= max(least, 2 * p) and not any(all(words[x] == words[x + q] for x in range(s, s + size - q)) for q in range(1, p)):
                out.append((s, size, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_document(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 12)
    gone = {x for s, m, q in found for x in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha(lines), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_of_random_words(letters):
    rng = random.Random(letters)
    for _ in range(150):
        docs = [[rng.randrange(letters) for _ in range(rng.randrange(50))] for _ in range(rng.randrange(1, 6))]
        least = rng.choice([2, 5, 12])
        which, *found = periodic.runs(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs]), least)
        assert list(zip(which.tolist(), *(c.tolist() for c in found))) == [(k, *r) for k, d in enumerate(docs) for r in plain_runs(d, least)]


def test_runs_of_fibonacci_words():
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    codes = np.frombuffer(b.encode(), np.uint8).astype(np.int64)
    _, *found = periodic.runs(codes, np.array([len(codes)]), 2)
    assert list(zip(*(c.tolist() for c in found))) == plain_runs(b, 2)


def test_periodic_runs_of_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(d, t) for d, t in rows if len(t or "") < 12_000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = periodic.periodic_runs(df, plant=True).collect()
    assert sorted(r[:8] for r in got) == sorted(plain_document(*r) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 10


def test_periodic_runs_awkward(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (None, "a " * 30), (4, "a " * 30), (4, "a " * 30), (5, "x\x1cy " * 12), (6, "ä ß ä ß " * 5 + "日本語"), (7, "one two"),
        (20, "p q r " * 200), (None, None)
    ]
    df = awkward(spark.createDataFrame(rows, "doc_id long, text string"))
    got = periodic.periodic_runs(df, plant=True, chunk_words=100).collect()
    assert sorted((r[:8] for r in got), key=str) == sorted((plain_document(*r) for r in rows), key=str)
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000 + " ".join(map(str, range(100_000))))], "doc_id long, text string")
    r = periodic.periodic_runs(long).first()
    assert (r.n_runs, r.start, r.length, r.period, r.n_words, r.n_dropped) == (1, 0, 200_000, 1, 300_000, 199_999)


# ---- 13 ----

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_divergence(rows, least_docs, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for x, _, terms in docs if x == lang for t in set(terms))
        kept = [t for t, n in df.items() if n >= least_docs]
        counts = defaultdict(Counter)
        for x, source, terms in docs:
            if x == lang:
                counts[source].update(t for t in terms if df[t] >= least_docs)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        excess = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            parts = {
                "pair": [(x, sum(excess(p[s][t], p[x][t]) for t in kept)) for x in counts if x != s],
                "term": [(t, excess(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]],
            }
            for part, found in parts.items():
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def found_divergence(spark, rows, **options):
    df = awkward(spark.createDataFrame(rows, "text string, lang string, source string"))
    got = divergence.source_divergence(df, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("sizes", [{}, {"slice_bytes": 300}])
def test_divergence_matches_all_terms(spark, sizes):
    rng = random.Random(7)
    words = ["Der", "die", "DAS", "naïve", "日本", "x", "y", "a-b", "c3po", "È"]
    rows = []
    for _ in range(250):
        lang, source = rng.choice(["de", "en", None]), rng.choice(["hot", "hot", "s1", "s2", "s3", None])
        rows.append((" ".join(rng.choice(words) * rng.randrange(1, 3) for _ in range(rng.randrange(12))), lang, source))
    got = found_divergence(spark, rows, least_docs=3, top=4, **sizes)
    assert got == plain_divergence(rows, 3, 4)
    assert len({r[0] for r in got}) == 3 and max(r[5] for r in got if r[2] == "term") == 4


def test_divergence_of_many_sources(spark):
    rng = random.Random(8)
    rows = [(" ".join(f"t{chr(97 + rng.randrange(20))}" for _ in range(3)), "en", f"s{k % 600}") for k in range(900)]
    assert found_divergence(spark, rows, least_docs=3, top=2) == plain_divergence(rows, 3, 2)  # two blocks of sources


def test_divergence_awkward(spark):
    rows = [(None, None, None), ("", "en", "a"), ("12 34", "en", "b"), ("word", "de", "a"), ("word", "de", "a"), ("word", "de", "a"), ("other", "de", "b"), ("wort " * 50_000, "fr", "only")] + [("wort", "fr", "only")] * 2
    got = found_divergence(spark, rows)
    assert got == plain_divergence(rows, 3, 200)
    assert ("en", "a", "pair", "b", 0, 1) in got and not [r for r in got if r[0] == "fr" and r[2] == "pair"]
    assert found_divergence(spark, []) == []


def test_terms_and_filter(spark):
    data, terms, counts = divergence.terms_of(["A1b-Ç\x7fÄz\n", "", "12 \x1c", " x", "y y"])
    assert data.decode() == "a b Ç Äz x y y " and [t.decode() for t in terms.to_pylist()] == ["a ", "b ", "Ç ", "Äz ", "x ", "y ", "y "]
    assert counts.tolist() == [4, 0, 0, 1, 2]
    assert divergence.terms_of([])[2].tolist() == [] and divergence.terms_of(["", "1"])[0] == b""
    words = divergence._filter(spark.createDataFrame([("de", "wort"), ("", "ß")], "lang string, term string"), 12)
    set_bits = {64 * k + b for k in np.flatnonzero(words).tolist() for b in range(64) if int(words[k]) >> b & 1}
    assert set_bits == {int(x) for lang, t in (("de", b"wort"), ("", "ß".encode())) for x in divergence.filter_places(lang, [t], 4096).ravel()}


@pytest.mark.parametrize("bits", [6, 8])
def test_divergence_with_a_full_filter(spark, bits):
    """Terms that pass the filter and aren't kept must not count."""
    rng = random.Random(bits)
    rows = [(" ".join("t" + "".join(rng.choice("abcdef") for _ in range(2)) for _ in range(6)), "en", f"s{k % 4}") for k in range(60)]
    assert found_divergence(spark, rows, least_docs=10, top=5, filter_bits=bits) == plain_divergence(rows, 10, 5)
