"""Maximal periodic runs of words, found exactly through string synchronising sets.

Positions get a name for each dyadic length 2^k: two positions of a text share it if and only if the
2^k words from them are equal.  At scale t = 2^k the synchronising set holds the positions i for which
the least hash of a name of length t over i..i+t stands at one of the two ends; names with a period up
to t / 3 are left out.  So whether i is chosen hangs on the 2t words from i alone.  A run of period
q in [3t, 6t) either holds two chosen positions q apart with equal 2t words, which propose it, or its
period is itself highly periodic, with period p <= t / 3: then two runs of period p, known from smaller
scales, meet in it and propose q by their phases.  Periods below 12 are found by direct comparison,
which supplies the small periods and the highly periodic regions.  Every proposal is extended exactly
by names of falling length, so nothing is estimated and nothing is lost.

All texts of a slice of some megabytes are handled at once; memory grows with the slice and its longest
text, and there is no shuffle.  Null and empty texts have no words; equal rows give equal rows; a null
doc_id is never rewritten; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.words import Words, mix, slices, utf8

DIRECT = 12  # periods below are compared directly: 3 times the first scale, 4
LEAST_LENGTH = 12
TOP = np.uint64(2**64 - 1)

SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Names:
    """`level[k][i]` is the first position of the same text with the same 2^k words as i; `shared[k]` are the
    positions, ascending, whose words recur; all other positions are their own name."""

    def __init__(self, words: np.ndarray, text: np.ndarray, ends: np.ndarray):
        self.n = n = len(words)
        key = mix(words ^ mix(text.astype(np.uint64) + np.uint64(1)))
        self.level: list[np.ndarray] = []
        self.shared: list[np.ndarray] = []
        self._add(np.arange(n), key)
        while len(self.shared[-1]):
            step = 1 << (len(self.level) - 1)
            name, at = self.level[-1], self.shared[-1]
            at = at[at + 2 * step <= ends[at]]
            recurs = np.zeros(n, bool)
            recurs[self.shared[-1]] = True
            at = at[recurs[at + step]]
            self._add(at, name[at].astype(np.int64) * n + name[at + step])

    def _add(self, at: np.ndarray, key: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(key)))
        name = np.arange(self.n)
        name[at] = np.repeat(at[heads], size)
        self.level.append(name)
        self.shared.append(np.sort(at[np.repeat(size > 1, size)]))

    def extended(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words from i on (right) and before i (left) equal those from j on and before j; i < j."""
        right, left = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            name, size = self.level[k], 1 << k
            fits = j + right < self.n
            fits[fits] = name[(i + right)[fits]] == name[(j + right)[fits]]
            right[fits] += size
            fits = i - left >= size
            fits[fits] = name[(i - left)[fits] - size] == name[(j - left)[fits] - size]
            left[fits] += size
        return right, left


def _direct(name: np.ndarray, period: int) -> np.ndarray:
    """Runs (start, end, period) of one small period, of at least two periods."""
    same = np.zeros(max(len(name) - period, 0) + 2, np.int8)
    same[1:-1] = name[:-period] == name[period:]
    edges = np.flatnonzero(np.diff(same))
    start, end = edges[::2], edges[1::2]
    whole = end - start >= period
    return np.stack([start[whole], end[whole] + period, np.full(whole.sum(), period)], 1)


def _primitive(runs: np.ndarray) -> np.ndarray:
    """One row per (start, end), with its smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    keep = np.ones(len(runs), bool)
    keep[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[keep]


def _chosen(names: Names, k: int, periodic: np.ndarray) -> np.ndarray:
    """The synchronising positions of scale 2^k whose 2^(k+1) words recur; `periodic` are known runs of period <= 2^k / 3."""
    scale, at, context = 1 << k, names.shared[k], names.shared[k + 1]
    key = mix(names.level[k][at].astype(np.uint64)) >> np.uint64(1)
    long = periodic[periodic[:, 1] - periodic[:, 0] >= scale]
    if len(long):
        change = np.zeros(names.n + 1, np.int64)
        np.add.at(change, long[:, 0], 1)
        np.add.at(change, long[:, 1] - scale + 1, -1)
        key[np.cumsum(change)[at] > 0] = TOP
    least, width = key.copy(), 1
    while width < scale + 1:
        step = min(width, scale + 1 - width)
        least[:-step] = np.minimum(least[:-step], least[step:])
        width += step
    x = np.searchsorted(at, context)  # the words of i..i+scale recur with the context, so they lie side by side in `at`
    m = least[x]
    return context[(m != TOP) & ((m == key[x]) | (m == key[x + scale]))]


def _context_pairs(names: Names, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chosen positions with equal contexts, 3 to 6 scales apart.  Equal contexts are over a third of a scale
    apart, else they'd be highly periodic, so a position meets a bounded number of others."""
    scale = 1 << k
    context = names.level[k + 1][at]
    order = np.lexsort((at, context))
    at, context = at[order], context[order]
    left, right, t = [], [], 1
    while t < len(at):
        apart = np.where(context[t:] == context[:-t], at[t:] - at[:-t], 6 * scale)
        if (apart >= 6 * scale).all():
            break
        far = np.flatnonzero((apart >= 3 * scale) & (apart < 6 * scale))
        left.append(at[far])
        right.append(at[far + t])
        t += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _region_pairs(names: Names, k: int, periodic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proposals from two highly periodic regions of one period that meet: periods that bring their phases together."""
    scale, none = 1 << k, np.zeros(0, np.int64)
    long = periodic[periodic[:, 1] - periodic[:, 0] >= 3 * scale]
    if len(long) < 2:
        return none, none
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    one, two = long[:-1], long[1:]
    meet = (one[:, 2] == two[:, 2]) & (two[:, 0] <= one[:, 1])
    one, two = one[meet], two[meet]
    if not len(one):
        return none, none
    p = one[:, 2]
    pair = np.repeat(np.arange(len(one)), p)
    x = one[pair, 1] - p[pair] - (np.arange(len(pair)) - np.repeat(np.cumsum(p) - p, p))
    right, _ = names.extended(x, two[pair, 0])
    fits = right >= p[pair]
    pair, x = pair[fits], x[fits]  # at most one each: the root is primitive
    one, two, p = one[pair], two[pair], p[pair]
    first = two[:, 0] - x
    first = first + np.maximum(0, -(-(3 * scale - first) // p)) * p
    last = np.minimum(6 * scale - 1, np.minimum(one[:, 1] - one[:, 0], two[:, 1] - two[:, 0]) + p)
    n = np.maximum(0, (last - first) // p + 1)
    pair = np.repeat(np.arange(len(one)), n)
    period = first[pair] + (np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)) * p[pair]
    i = np.maximum(one[pair, 0], two[pair, 0] - period)
    inside = i + period < two[pair, 1]
    return i[inside], (i + period)[inside]


def runs_of(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All runs (start, end, smallest period) of at least two periods in texts of `counts` words; positions over all texts."""
    ends = np.repeat(np.cumsum(counts), counts)
    if not len(words):
        return np.zeros((0, 3), np.int64)
    names = Names(words, np.repeat(np.arange(len(counts)), counts), ends)
    found = _primitive(np.concatenate([_direct(names.level[0], q) for q in range(1, min(DIRECT, len(words)))] or [np.zeros((0, 3), np.int64)]))
    for k in range(2, len(names.level)):
        if not len(names.shared[k]):
            break
        periodic = found[3 * found[:, 2] <= 1 << k]
        i, j = _context_pairs(names, k, _chosen(names, k, periodic)) if k + 1 < len(names.level) and len(names.shared[k + 1]) else (np.zeros(0, np.int64),) * 2
        a, b = _region_pairs(names, k, periodic)
        i, j = np.concatenate([i, a]), np.concatenate([j, b])
        if len(i):
            right, left = names.extended(i, j)
            start, end, period = i - left, j + right, j - i
            whole = end - start >= 2 * period
            found = _primitive(np.concatenate([found, np.stack([start, end, period], 1)[whole]]))
    return found


def rewritten(doc_ids: list, counts: np.ndarray) -> np.ndarray:
    """Which original word stands at each position: texts with crc32(doc_id) divisible by 10 repeat a period from some word on."""
    out = np.arange(int(counts.sum()))
    base = 0
    for doc_id, n in zip(doc_ids, counts.tolist()):
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[base + a: base + n] = base + a + np.arange(n - a) % p
        base += n
    return out


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given words each followed by a space, as bytes, and where each begins."""
    size = end - start + 1
    begin = np.cumsum(size) - size
    at = np.repeat(start - begin, size) + np.arange(int(size.sum()))
    out = data[np.minimum(at, max(len(data) - 1, 0))] if len(at) else np.zeros(0, np.uint8)
    out[begin + size - 1] = 0x20
    return out, begin


def _slice(doc_ids: list, column: pa.Array, rewrite: bool) -> list[tuple]:
    data, offsets = utf8(column)
    words = Words(data, offsets, lower=False)
    counts = words.counts
    source = rewritten(doc_ids, counts) if rewrite else np.arange(len(words.hash))
    found = runs_of(words.hash[source], counts)
    found = found[found[:, 1] - found[:, 0] >= LEAST_LENGTH]
    change = np.zeros(len(source) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    picked = source[kept]
    joined, begin = _joined(data, words.start[picked], words.end[picked])
    begin = np.append(begin, len(joined))
    edges = np.concatenate([[0], np.cumsum(counts)])
    kept_edges = np.concatenate([[0], np.cumsum(kept)])[edges]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    run_edges = np.searchsorted(found[:, 0], edges)
    whole, rows = joined.tobytes(), []
    for d, doc_id in enumerate(doc_ids):
        runs = found[run_edges[d]: run_edges[d + 1]]
        length = runs[:, 1] - runs[:, 0]
        lines = "".join(f"{s - edges[d]},{n},{q}\n" for s, n, q in zip(runs[:, 0].tolist(), length.tolist(), runs[:, 2].tolist()))
        low, high = int(begin[kept_edges[d]]), int(begin[kept_edges[d + 1]]) - 1
        best = (None,) * 4
        if len(runs):
            b = int(np.lexsort((runs[:, 2], runs[:, 0], -length))[0])
            n, q = int(length[b]), int(runs[b, 2])
            best = int(runs[b, 0] - edges[d]), n, q, 1000 * n // q
        rows.append((doc_id, int(counts[d]), len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(whole[low: max(low, high)]).hexdigest()))
    return rows


def periodic_runs(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """doc_id, n_words, n_runs, the longest run (start, length, period, exponent_milli), and digests of all runs
    and of the text with every run cut to its first period.  With `rewrite` the texts are first made periodic by
    the rule of `rewritten`, which plants runs of all sizes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")]
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0).to_pylist()
            for first, last in slices(texts):
                rows = _slice(ids[first:last], texts.slice(first, last - first), rewrite)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, SCHEMA)
