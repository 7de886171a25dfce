"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

A window of a document has as many words as the item it is held against; a document with fewer words is
one window, whole.  Both are sets of five-word
shingles with weights (how often each occurs), and a window holds an item where the weighted
Jaccard similarity - sum of minima over sum of maxima - is 0.75 or more.

Fingerprints have 64 bits.  An item's fingerprint is cut into four blocks of 16 bits; a window within
RADIUS of it agrees with at least one block up to RADIUS // 4 bits, so tables from block values to
the items that near give every item within RADIUS.  Only then is the similarity computed exactly.
Windows that hold none of an item's shingles have similarity 0 and get no fingerprint.

Items are read in slices of SLICE, each its own pass, so what a task holds is bounded.  Null or empty
items and texts match nothing; an item of fewer than five words is its whole word sequence, held against
windows of its length.  Rows repeat as they come; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.words import SHINGLE, Words, mix, slices, utf8

SIMILARITY = 75     # percent
RADIUS = 24         # of 64 bits: at similarity 0.75 some 11 differ, deviation 3
BLOCKS = 4
SLICE = 1_000       # items in one pass
SHIFTS = np.arange(64, dtype=np.uint64)
POPCOUNT16 = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return sum(POPCOUNT16[(x >> np.uint64(16 * j)) & np.uint64(0xFFFF)].astype(np.int64) for j in range(4))


def signs(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 values, +1 or -1, for each shingle hash."""
    return ((mix(hashes)[:, None] >> SHIFTS) & np.uint64(1)).astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << SHIFTS).sum(axis=1, dtype=np.uint64)


class Items:
    """Benchmark items as shingle sets, by their number of words, with block tables."""

    def __init__(self, texts: pa.Array):
        data, offsets = utf8(texts)
        w = Words(data, offsets)
        text, hashed = w.shingles()
        self.bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.by_length: dict[int, np.ndarray] = {}
        prints, numbers = [], []
        for i in range(len(offsets) - 1):
            own = hashed[text == i] if len(offsets) < 300 else hashed[np.searchsorted(text, i): np.searchsorted(text, i, "right")]
            if len(own):
                self.bags[i] = np.unique(own, return_counts=True)
                prints.append(fingerprint(signs(own).sum(axis=0)[None, :])[0])
                numbers.append(i)
        self.print = np.array(prints, np.uint64)
        self.number = np.array(numbers, np.int64)
        self.length = w.counts[self.number] if len(numbers) else np.zeros(0, np.int64)
        self.shingles = np.unique(hashed)
        self.first_look = np.zeros(1 << 20, bool)
        self.first_look[self.shingles >> np.uint64(44)] = True
        near = POPCOUNT16 <= RADIUS // BLOCKS
        self.tables = []  # for each length: items, and for each block an array (items, 65536) packed to bits
        values = np.arange(1 << 16, dtype=np.uint32)
        for length in np.unique(self.length):
            at = np.flatnonzero(self.length == length)
            blocks = [np.packbits(np.stack([near[values ^ np.uint32((int(self.print[i]) >> (16 * j)) & 0xFFFF)] for i in at]), axis=0) for j in range(BLOCKS)]
            self.tables.append((int(length), at, blocks))

    def matches(self, texts: pa.Array) -> list[tuple[int, int, float]]:
        """(row, item, best similarity) over all windows of the texts."""
        out: list[tuple[int, int, float]] = []
        for first, last in slices(texts):
            w = Words(*utf8(texts.slice(first, last - first)))
            out += [(first + t, int(i), s) for (t, i), s in self._search(w).items()]
        return out

    def _held(self, hashes: np.ndarray) -> np.ndarray:
        hit = self.first_look[hashes >> np.uint64(44)]
        spot = np.flatnonzero(hit)
        at = np.searchsorted(self.shingles, hashes[spot])
        at[at == len(self.shingles)] = 0
        hit[spot] = self.shingles[at] == hashes[spot]
        return hit

    def _search(self, w: Words) -> dict[tuple[int, int], float]:
        best: dict[tuple[int, int], float] = {}
        opens = np.cumsum(w.counts) - w.counts  # each text's first word
        for size in {min(SHINGLE, length) for length, _, _ in self.tables}:
            every = w.windows(size)
            hit = self._held(every) if len(every) else np.zeros(0, bool)
            hit &= w.text[: len(every)] == w.text[size - 1:] if len(every) else hit
            if not hit.any():
                continue
            seen = np.concatenate([[0], np.cumsum(hit)])
            spots = np.flatnonzero(hit)
            for length, at, blocks in self.tables:
                if min(SHINGLE, length) != size:
                    continue
                # a window that can reach the similarity has the better part of an item's shingles
                span, m = length - size + 1, len(w.hash) - length + 1
                need = -(-SIMILARITY * span // 100)
                if len(spots) < need:
                    continue
                short = np.flatnonzero((w.counts < length) & (w.counts >= need + size - 1))
                short = short[seen[opens[short] + w.counts[short] - size + 1] - seen[opens[short]] >= need]
                for n in np.unique(w.counts[short]):
                    whole = opens[short[w.counts[short] == n]]
                    for part in np.array_split(whole, -(-len(whole) // 4096)):
                        self._verify(w, every, part, int(n) - size + 1, at, blocks, best)
                if m <= 0:
                    continue
                near = spots[: len(spots) - need + 1][spots[need - 1:] - spots[: len(spots) - need + 1] < span]
                start = np.unique((near[:, None] - np.arange(span)[None, :]).ravel())
                start = start[(start >= 0) & (start < m)]
                start = start[(seen[start + span] - seen[start] >= need) & (w.text[start] == w.text[start + length - 1])]
                for part in np.array_split(start, max(1, len(start) // 4096)):
                    if len(part):
                        self._verify(w, every, part, span, at, blocks, best)
        return best

    def _verify(self, w, every, start, span, at, blocks, best) -> None:
        low, high = int(start.min()), int(start.max()) + span
        if high - low <= 8 * len(start) + 4 * span:  # dense: running sums
            running = np.zeros((high - low + 1, 64), np.int32)
            np.cumsum(signs(every[low:high]), axis=0, out=running[1:])
            sums = running[start - low + span] - running[start - low]
        else:
            sums = np.stack([signs(every[s: s + span]).sum(axis=0) for s in start])
        prints = fingerprint(sums)
        mask = np.zeros((len(start), blocks[0].shape[0]), np.uint8)
        for j in range(BLOCKS):
            mask |= blocks[j][:, (prints >> np.uint64(16 * j)) & np.uint64(0xFFFF)].T
        window, column = np.nonzero(np.unpackbits(mask, axis=1, count=len(at)))
        item = at[column]
        close = distance(prints[window], self.print[item]) <= RADIUS
        window, item = window[close], item[close]
        for i in np.unique(item):
            bag = self.bags[int(self.number[i])][0]
            own = window[item == i]
            inside = every[start[own][:, None] + np.arange(span)[None, :]]
            at_bag = np.searchsorted(bag, inside)
            at_bag[at_bag == len(bag)] = 0
            enough = (bag[at_bag] == inside).sum(axis=1) * 100 >= SIMILARITY * span  # bounds what they can share
            self._compare(w, every, start[own[enough]], span, i, best)

    def _compare(self, w, every, starts, span, i, best) -> None:
        for k in starts:
            hashes, weight = np.unique(every[k: k + span], return_counts=True)
            other, other_weight = self.bags[int(self.number[i])]
            _, a, b = np.intersect1d(hashes, other, assume_unique=True, return_indices=True)
            shared = int(np.minimum(weight[a], other_weight[b]).sum())
            union = int(weight.sum() + other_weight.sum() - shared)
            if shared * 100 >= SIMILARITY * union:
                key = (int(w.text[k]), int(self.number[i]))
                best[key] = max(best.get(key, 0.0), shared / union)


def _slices(benchmark: DataFrame) -> Iterator[tuple[list, pa.Array]]:
    """Items in slices of SLICE distinct (item_id, text), in an order that a repeated run keeps."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    n = rows.count()
    parts = max(1, -(-n // SLICE))
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        got = part.toArrow()
        text = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
        yield got.column("item_id").to_pylist(), (pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity: each item that some window of a document holds, with the best window's figure."""
    found = None
    for ids, texts in _slices(benchmark):
        part = _held(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ids, texts)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def _held(docs: DataFrame, ids: list, texts: pa.Array) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((ids, texts.to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, items = shared.value[0], Items(pa.array(shared.value[1], pa.string()))
        for batch in batches:
            got = items.matches(batch.column(1)) if batch.num_rows else []
            doc = batch.column(0).take(pa.array([t for t, _, _ in got], pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array([own[i] for _, i, _ in got], pa.int64()), pa.array([s for _, _, s in got], pa.float64())],
                                             ["doc_id", "item_id", "similarity"])

    return docs.mapInArrow(run, "doc_id long, item_id long, similarity double")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns as they are, that hold no item."""
    for ids, texts in _slices(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(texts.to_pylist())
        docs = docs.where(~_flag(shared)(F.col("text").cast("string")))
    return docs


def _flag(shared):
    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = Items(pa.array(shared.value, pa.string()))
        for texts in batches:
            out = np.zeros(len(texts), bool)
            for t, _, _ in items.matches(pa.array(texts, pa.string(), from_pandas=True)):
                out[t] = True
            yield pd.Series(out)

    return holds
