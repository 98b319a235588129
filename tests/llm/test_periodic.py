"""Periodic runs against a comparison of every word with the word q later, for every q."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from stratavox.llm import periodic


def brute(t, least=12):
    out, n = [], len(t)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if t[i] == t[i + q]:
                j = i
                while j + q < n and t[j] == t[j + q]:
                    j += 1
                size, s = j + q - i, t[i : j + q]
                if size >= max(least, 2 * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                    out.append((i, size, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def row(words):
    runs = brute(words)
    gone = {x for a, m, q in runs for x in range(a + q, a + m)}
    kept = " ".join(w for x, w in enumerate(words) if x not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest, hashlib.sha256(kept.encode()).hexdigest())


def made(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def some(r):
    kind, n = r.random(), r.randrange(0, 80)
    if kind < 0.35:
        return [r.randrange(r.choice([1, 2, 3])) for _ in range(n)]
    if kind < 0.7:
        p = [r.randrange(4) for _ in range(r.randrange(1, 9))]
        t = [p[i % len(p)] for i in range(n)]
        for _ in range(r.randrange(3)):
            if t:
                t[r.randrange(len(t))] = r.randrange(5)
        return t
    base, t = [r.randrange(3) for _ in range(5)], []
    while len(t) < n:
        t += base * r.randrange(1, 4) if r.random() < 0.6 else [r.randrange(6) for _ in range(r.randrange(6))]
    return t


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_of_texts_taken_together(seed):
    r = random.Random(seed)
    for _ in range(600):
        docs = [some(r) for _ in range(r.randrange(1, 5))]
        assert periodic.periodic_runs([np.array(t, np.int64) for t in docs]) == [brute(t) for t in docs]


def test_squares_blocks_and_suffixes_alone():
    r = random.Random(4)
    for _ in range(400):
        t = [r.randrange(r.choice([1, 2, 3])) for _ in range(r.randrange(1, 40))]
        sa = periodic.suffix_array(np.array(t), np.zeros(len(t), int)).tolist()
        assert sa == sorted(range(len(t)), key=lambda i: t[i:])
        rank = np.argsort(sa).tolist()
        lcp = periodic.common_prefixes(t, sa, rank)
        starts = periodic.blocks(sa, lcp)
        for h, h1 in zip(starts, starts[1:]):
            again = [any(t[j : j + m] == t[h : h + m] for j in range(h)) for m in (h1 - h, h1 - h + 1)]
            assert (again[0] or h1 - h == 1) and (h1 == len(t) or not again[1])
        kinds = periodic.vocabulary(t, sa, rank, lcp, periodic.covering_squares(t, starts))
        got = {tuple(t[sa[lo] : sa[lo] + 2 * k]) for lo, k in kinds}
        want = set()
        for i in range(len(t)):
            for k in range(1, (len(t) - i) // 2 + 1):
                half = t[i : i + k]
                if half == t[i + k : i + 2 * k] and not any(k % d == 0 and half == half[:d] * (k // d) for d in range(1, k)):
                    want.add(tuple(half * 2))
        assert got == want


def test_long_texts_take_linear_time():
    a, b = [0], [0, 1]
    while len(b) < 30_000:
        a, b = b, b + a
    assert periodic.periodic_runs([np.zeros(100_000, np.int64)]) == [[(0, 100_000, 1)]]
    assert periodic.periodic_runs([np.arange(100_000) % 40_000]) == [[(0, 100_000, 40_000)]]
    assert len(periodic.periodic_runs([np.array(b)])[0]) > 5_000


def test_edges(spark):
    long = " ".join(f"w{i % 5000}" for i in range(12_000))
    rows = [(1, None, 0), (2, "", 0), (None, "a b " * 12, 0), (4, "the " * 11, 0), (4, "the " * 12, 0), (5, "x\x1fy z z　" * 20, 0), (6, long, 0), (6, long, 0), (7, " \t\n\x0b\x0c\r", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = sorted((tuple(x) for x in periodic.run_detection(df).collect()), key=str)
    short = [x for x in got if x[0] != 6]
    assert short == sorted(((i, *row(split(x))) for i, x, _ in rows if i != 6), key=str)
    assert [x[1:6] for x in got if x[0] == 6] == [(1, 0, 12_000, 5_000, 2_400)] * 2
    assert periodic.run_detection(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = {x.doc_id: x.text for x in periodic.collapse_documents(df.filter("doc_id in (4, 6) AND length(text) > 44").dropDuplicates(["doc_id"])).collect()}
    assert out == {4: "the", 6: " ".join(f"w{i}" for i in range(5000))}


def test_query_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    docs = {i: t for i, t in docs if len(split(t)) < 1500}
    got = {x[0]: tuple(x[1:8]) for x in periodic.op13_periodic_runs(spark, small).collect()}
    assert {i: got[i] for i in docs} == {i: row(made(split(t), i)) for i, t in docs.items()}
    assert any(x[0] for x in got.values())
