"""Periodic runs against plain comparison of every period, on words built to be awkward."""

import hashlib
import random
import re
import zlib

import numpy as np

from blockloom.llm.periodic import periodic_runs, runs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """(start, end) -> smallest period, of all maximal stretches of at least two periods."""
    best, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                best.setdefault((i, j + q), q)
            i = j + 1
    return best


def awkward(rng):
    n, kind = rng.randint(0, 260), rng.randrange(6)
    if kind == 0:
        return [rng.randint(0, 1) for _ in range(n)]
    if kind == 1:  # Fibonacci words hold the most runs of all
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 2:
        base = [rng.randint(0, 3) for _ in range(rng.randint(1, 60))]
        return [base[i % len(base)] for i in range(n)]
    if kind == 3:  # a period that is itself periodic but for a break
        u = [rng.randint(0, 1) for _ in range(rng.randint(1, 4))]
        return ((u * rng.randint(3, 20) + u[: rng.randint(0, len(u) - 1)] + [rng.randint(0, 2)] * rng.randint(0, 1)) * rng.randint(2, 6))[:400]
    if kind == 4:
        return [x for _ in range(5) for x in [rng.randint(0, 2) for _ in range(rng.randint(1, 30))] * rng.randint(1, 5)][:500]
    w = ([0] * rng.randint(5, 80) + [1]) * rng.randint(2, 5)
    w[rng.randrange(len(w))] = rng.randint(0, 2)
    return w


def test_runs_of_awkward_words():
    rng = random.Random(3)
    for _ in range(150):
        texts = [awkward(rng) for _ in range(rng.randint(1, 5))]
        got = runs_of(np.array([x for t in texts for x in t], np.uint64), np.array([len(t) for t in texts]))
        want, base = [], 0
        for t in texts:
            want += [(s + base, e + base, q) for (s, e), q in brute(t).items()]
            base += len(t)
        assert sorted(map(tuple, got.tolist())) == sorted(want)


def digest(doc_id, text, rewrite):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if rewrite and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = sorted((s, e - s, q) for (s, e), q in brute(w).items() if e - s >= max(12, 2 * q))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_documents(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([" ", "\n ", "\t"]).join(rng.choice(["a", "é", "lorem,", "b"]) + "x" * rng.choice([0, 0, 30]) for _ in range(rng.randint(0, 150)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "one"), (104, "a " * 3000), (105, ("x y " * 40 + "z ") * 9), (None, "a b " * 20), (7, rows[8][1]), (7, rows[8][1])]
    docs = spark.createDataFrame([(d, t, 1, "r") for d, t in rows], "doc_id long, text string, n_runs int, runs string").repartition(3)
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for rewrite in (False, True):
        got = sorted(map(tuple, periodic_runs(docs, rewrite).select(*columns).collect()), key=repr)
        assert got == sorted((digest(d, t, rewrite) for d, t in rows), key=repr)
    assert periodic_runs(docs.where("false")).count() == 0
