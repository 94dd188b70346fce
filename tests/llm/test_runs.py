"""Periodic runs against brute force."""

import hashlib
import random

import numpy as np
from pyspark.sql import Row

from trailmark.llm import runs
from trailmark.llm.queries import op12_runs


def brute(ids):
    n, out = len(ids), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if ids[i] != ids[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and ids[j] == ids[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                out.setdefault((i, j + p), p)
            i = j
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_symbols():
    rng = random.Random(2)
    for _ in range(80):
        texts = []
        for _ in range(rng.randrange(1, 10)):
            t, most = [], rng.randrange(1, 4)
            for _ in range(rng.randrange(6)):
                t += [rng.randrange(most + 1) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 9)
            texts.append(np.array(t * (5 if rng.random() < 0.1 else 1), np.int64))
        assert runs.runs_of(texts) == [brute(t.tolist()) for t in texts]


def test_long_texts():
    rng = random.Random(3)
    t = np.array([rng.randrange(3) for _ in range(4000)] + [0] * 1500 + [1, 2] * 1000, np.int64)
    assert runs.runs_of([t]) == [brute(t.tolist())]
    assert runs.runs_of([np.zeros(100_000, np.int64)]) == [[(0, 100_000, 1)]]


def test_extensions():
    rng = np.random.default_rng(4)
    row = np.append(np.repeat(rng.integers(0, 2, 300), rng.integers(1, 5, 300)), 2)
    levels = runs.grammar(row, 1)
    a, b = rng.integers(0, len(row) - 1, 500), rng.integers(0, len(row) - 1, 500)
    a, b = a[a != b], b[a != b]
    expected = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        n = 0
        while max(i, j) + n < len(row) and row[i + n] == row[j + n]:
            n += 1
        expected.append(n)
    assert runs.extensions(levels, a, b).tolist() == expected


def expected_row(doc, text):
    words = (text or "").encode().split()
    order = runs.planted(doc, len(words)).tolist()
    words = [words[k] for k in order]
    found = brute(words)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = runs.strongest(found) or (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return Row(doc, len(found), *best, milli, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) < 8000]
    whole = {r.doc_id: r for r in op12_runs(spark, sf).collect()}
    assert all(tuple(whole[d]) == tuple(expected_row(d, t)) for d, t in docs)
    assert sum(r.n_runs > 0 for r in whole.values()) > len(whole) / 20


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 5), (5, "a " * 6), (6, "a\x0bb\x1cc " * 4), (6, "a b " * 4), (None, "ä ö " * 4), (7, "w " * 100_000)]
    df = spark.createDataFrame([(*r, [1], "x") for r in rows], "doc_id long, text string, runs array<int>, collapsed string")
    got = {(r.doc_id, r.words): r for r in runs.find(df).collect()}
    assert [got[k, n].runs for k, n in ((1, 0), (2, 0), (3, 0), (4, 5))] == [[]] * 4
    assert got[5, 6].runs == [Row(start=0, length=6, period=1)] and bytes(got[5, 6].collapsed) == b"a"
    assert got[6, 8].runs == [Row(start=0, length=8, period=2)] and bytes(got[None, 8].collapsed).decode() == "ä ö"
    assert got[7, 100_000].runs == [Row(start=0, length=100_000, period=1)]
    assert runs.digests(runs.find(df.filter("false"))).count() == 0
