"""Exact removal of repeated 200-byte strings with a sampled suffix array.

Suffixes are sampled where a text's own bytes say so: the start of a 200-byte string whose K-byte head of
least hash begins there.  Equal strings choose equal heads at equal distances, so every repeat of a string
is a pair of sampled suffixes with the same head; some two in 150 bytes are sampled, not all.

1.  A sampled suffix carries the fingerprint of its head, the range of string starts that chose it, and
    the fingerprint of all bytes those strings cover.  Splitters from a sample range-partition the suffixes by
    these fingerprints and then by place, so equal suffixes in any number are dealt over as many buckets
    as they need.  A bucket is sorted and neighbours are compared: equal coverage means that every
    string of both repeats.  Heads that meet with different coverage, and those at a bucket's ends,
    which may go on in the next one, are passed on with one suffix for each coverage.
2.  For these few the strings are compared one by one, as fingerprints grouped over the cluster.
3.  The strings that repeat come back to their documents, and the bytes they cover go.

Only ranges and fingerprints of 64 bits travel; texts are shuffled once, dealt by a hash.  Null texts count
as empty.  Rows repeat as they come, and a repeated row is a repeat of its text; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.idfilter import filter_of, passes
from blockloom.llm.words import _BYTE, mix, powers, slices, utf8
from blockloom.session import materialise, prepare

LENGTH = 200
HEAD = 50
CHUNK = 1 << 19     # string starts looked at together
SLICE_DOCS = 800
HELD = 500_000      # suffixes with one head that a task holds
_PLACE = np.uint64((1 << 24) - 1)
REPEATS, OPEN, KNOWN = 0, 1, 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Sums:
    """Running polynomial sums over bytes, from which any substring's fingerprint is two look-ups."""

    def __init__(self, data: np.ndarray):
        forth, self.back = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * forth[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def every(self, length: int) -> np.ndarray:
        """Of the substrings of one length, from each byte on."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.back[:n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of `width` values."""
    n = len(values)
    pad = -n % width
    padded = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()[:n]
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(behind[: n - width + 1], ahead[width - 1:])


def sampled(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, head: int = HEAD):
    """(text, low, high, key, cover) of the sampled suffixes of some texts; low..high are string starts."""
    out = []
    n = len(data)
    for first in range(0, max(0, n - length + 1), CHUNK):
        part = data[first: first + CHUNK + length - 1]
        m = len(part) - length + 1
        if m <= 0:
            break
        sums = Sums(part)
        value = (sums.every(head) & ~_PLACE) | np.arange(len(part) - head + 1, dtype=np.uint64)
        chosen = (_least(value, length - head + 1)[:m] & _PLACE).astype(np.int64)
        start = np.arange(first, first + m)
        text = np.searchsorted(offsets, start, side="right") - 1
        whole = start + length <= offsets[text + 1]
        spot = np.flatnonzero(whole)
        if not len(spot):
            continue
        new = np.ones(len(spot), bool)
        new[1:] = (chosen[spot[1:]] != chosen[spot[:-1]]) | (text[spot[1:]] != text[spot[:-1]]) | (spot[1:] != spot[:-1] + 1)
        low = spot[new]
        high = np.append(spot[np.flatnonzero(new)[1:] - 1], spot[-1])
        at = chosen[low]
        key = sums.of(at, at + head)
        cover = mix(sums.of(low, high + length) + (at - low).astype(np.uint64) * _A + (high - low).astype(np.uint64) * _B)
        owner = text[low]
        out.append((owner, low + first - offsets[owner], high + first - offsets[owner], key, cover))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _suffixes(docs: DataFrame, length: int, head: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column(1), CHUNK):
                text, low, high, key, cover = sampled(*utf8(batch.column(1).slice(first, last - first)), length, head)
                ids = batch.column(0).slice(first, last - first).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cover.view(np.int64)), pa.array(ids[text] if len(text) else np.zeros(0, np.int64)),
                                                  pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["key", "cover", "id", "low", "high"])

    return docs.select("id", "text").mapInArrow(run, "key long, cover long, id long, low int, high int")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a sorted bucket: (id, low, high, kind).  REPEATS: a suffix whose coverage repeats.  OPEN: the only one
    of its coverage, yet to be compared with others of its head; KNOWN: one that the OPEN ones are compared with,
    of a coverage that repeats."""
    names = ["key", "cover", "id", "low", "high"]
    rest, opening = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(k).to_numpy() for k in range(5)]
        if rest is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(rest, rows)]
        # the last head may go on in the next batch; of a long one only what decides about it is kept
        cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
        if cut:
            yield from _compared([r[:cut] for r in rows], opening, False)
            opening = False
            rest = [r[cut:] for r in rows]
        elif len(rows[0]) > HELD:
            # one head fills it all: what is known is given out, and the last coverage stays
            last = int(np.searchsorted(rows[1], rows[1][-1], side="left")) if rows[1][0] != rows[1][-1] else len(rows[1]) - 2
            yield from _compared([r[:last] for r in rows], True, True)
            rest, opening = [r[last:] for r in rows], True
        else:
            rest = rows
    if rest is not None:
        yield from _compared(rest, opening, True)


def _compared(rows: list[np.ndarray], opening: bool, closing: bool) -> Iterator[pa.RecordBatch]:
    key, cover, ident, low, high = rows
    if not len(key):
        return
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new = new_key | np.concatenate([[True], cover[1:] != cover[:-1]])
    group, head = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    size = np.bincount(group)
    first = np.flatnonzero(new)
    variants = np.bincount(head[first])
    passed = variants[head[first]] > 1
    if opening:
        passed |= head[first] == 0
    if closing:
        passed |= head[first] == head[-1]
    repeats = np.flatnonzero(size[group] > 1)
    at = np.concatenate([repeats, first[passed]])
    kind = np.concatenate([np.full(len(repeats), REPEATS, np.int8), np.where(size[passed] > 1, KNOWN, OPEN).astype(np.int8)])
    yield pa.RecordBatch.from_arrays([pa.array(ident[at]), pa.array(low[at]), pa.array(high[at]), pa.array(kind)], ["id", "low", "high", "kind"])


def _strings(length: int):
    def run(key: tuple, docs: pa.Table, wanted: pa.Table) -> pa.Table:
        """The fingerprint of each string in the wanted ranges of a slice's documents."""
        prints, ids, starts = [], [], []
        if wanted.num_rows:
            order = np.argsort(wanted.column("id").to_numpy(), kind="stable")
            ident, low, high, kind = (wanted.column(c).to_numpy()[order] for c in ("id", "low", "high", "kind"))
            texts = docs.column("text")
            for k, doc in enumerate(docs.column("id").to_pylist()):
                a, b = np.searchsorted(ident, doc), np.searchsorted(ident, doc, side="right")
                if a == b:
                    continue
                data = np.frombuffer(texts[k].as_py().encode("utf-8"), np.uint8)
                for c in range(a, b):
                    own = Sums(data[low[c]: high[c] + length])
                    prints.append(own.every(length))
                    place = np.arange(low[c], high[c] + 1)
                    starts.append(place if kind[c] == OPEN else -1 - place)  # negative: only to compare with
                    ids.append(np.full(len(starts[-1]), doc))
        none = np.zeros(0, np.int64)
        return pa.table({"string": pa.array(np.concatenate(prints).view(np.int64) if prints else none), "id": pa.array(np.concatenate(ids) if ids else none),
                         "low": pa.array((np.concatenate(starts) if starts else none).astype(np.int32))})

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, low, high) of the string starts whose string some other row of the sorted partition has too, but
    for negative ones, of which that is known."""
    last: list | None = None  # the row before, and whether it is given out already
    for batch in batches:
        if not batch.num_rows:
            continue
        string, ident, low = (batch.column(k).to_numpy() for k in range(3))
        same = np.zeros(len(string), bool)
        same[1:] = string[1:] == string[:-1]
        same[:-1] |= string[1:] == string[:-1]
        extra_id, extra_low = ident[:0], low[:0]
        if last is not None and last[0] == string[0]:
            same[0] = True
            if not last[3] and last[2] >= 0:
                extra_id, extra_low = np.array([last[1]], ident.dtype), np.array([last[2]], low.dtype)
        at = np.flatnonzero(same & (low >= 0))
        out_id, out_low = np.concatenate([extra_id, ident[at]]), np.concatenate([extra_low, low[at]])
        last = [string[-1], ident[-1], low[-1], bool(same[-1])]
        yield pa.RecordBatch.from_arrays([pa.array(out_id), pa.array(out_low), pa.array(out_low)], ["id", "low", "high"])


def _cleaned(length: int):
    def run(key: tuple, docs: pa.Table, marks: pa.Table) -> pa.Table:
        ident, low, high = (marks.column(c).to_numpy() for c in ("id", "low", "high")) if marks.num_rows else (np.zeros(0, np.int64),) * 3
        order = np.argsort(ident, kind="stable")
        ident, low, high = ident[order], low[order], high[order]
        rows = []
        for doc_id, doc, text in zip(docs.column("doc_id").to_pylist(), docs.column("id").to_pylist(), docs.column("text")):
            raw = text.as_py().encode("utf-8")
            a, b = np.searchsorted(ident, doc), np.searchsorted(ident, doc, side="right")
            removed = spans = 0
            kept = raw
            if a < b:
                change = np.zeros(len(raw) + 1, np.int64)
                np.add.at(change, low[a:b], 1)
                np.add.at(change, high[a:b] + length, -1)
                gone = np.cumsum(change)[:-1] > 0
                removed = int(gone.sum())
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((doc_id, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*rows))
        return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "n_bytes": pa.array(columns[1], pa.int64()), "n_removed": pa.array(columns[2], pa.int64()),
                         "n_spans": pa.array(columns[3], pa.int64()), "kept_sha256": pa.array(columns[4]), "kept": pa.array(columns[5], pa.binary())}) if rows else \
            pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()),
                      "n_spans": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string()), "kept": pa.array([], pa.binary())})

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay), a row per document."""
    prepare(docs.sparkSession)
    n_slices = -(-docs.count() // SLICE_DOCS) or 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("id", F.xxhash64("doc_id", "text"))
    order = ["key", "cover", "id", "low"]
    suffixes = _suffixes(docs, length, head).repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialise(suffixes.mapInArrow(_neighbours, "id long, low int, high int, kind tinyint"))
    slice_of = F.pmod("id", F.lit(n_slices))
    # documents without any such suffix stay as they are and need not be dealt
    concerned = passes(docs.sparkSession.sparkContext.broadcast(filter_of(found.select("id").distinct(), "id")), F.col("id"))
    dealt = docs.where(concerned).withColumn("slice", slice_of)
    open_ones = found.where(F.col("kind") != REPEATS).withColumn("slice", slice_of)
    strings = dealt.groupBy("slice").cogroup(open_ones.groupBy("slice")).applyInArrow(_strings(length), "string long, id long, low int")
    late = strings.repartition("string").sortWithinPartitions("string", "id", "low").mapInArrow(_repeated, "id long, low int, high int")
    marks = found.where(F.col("kind") == REPEATS).select("id", "low", "high").unionByName(late).withColumn("slice", slice_of)
    changed = dealt.groupBy("slice").cogroup(marks.groupBy("slice")).applyInArrow(
        _cleaned(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    raw = F.col("text").cast("binary")
    return changed.unionByName(docs.where(~concerned).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), raw.alias("kept")))
