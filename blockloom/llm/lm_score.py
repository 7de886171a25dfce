"""Stupid-backoff scores of documents against the corpus they are in.

Documents are dealt by a hash into slices of bounded size.  A slice explodes its texts into n-grams
and adds equal ones up.  Most n-grams occur in one document only and count nothing there, so a slice
first sends its distinct n-grams as short numbers to tables partitioned by n-gram hash, which mark those
that no other slice has; an n-gram with that mark that occurs once in its slice is not asked for.  The counts of the
others go to the tables, with the bits of their hashes that the short numbers left out, and are summed; each table answers a slice with the totals
of the n-grams it asked for, and the slice sums scores per document.  What is shuffled is a number for
each distinct n-gram of a slice, never for each occurrence: a very frequent n-gram, or a text repeated
many times, is one entry a slice.

A document's own n-grams don't count for it.  For a word w after the history h, of order - 1 words at most:
count(hw) / count(h) if hw occurs elsewhere, else ALPHA times the score with the history cut at its
first word; at the end count(w) / words, and for a word not seen elsewhere ALPHA / (words + 1).
Words are split at space and 0x09-0x0D, A-Z taken as lower case.  Null and empty texts have a null
score; rows repeat as they come, and each counts as a document of its own; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.words import Words, utf8
from blockloom.session import prepare

ORDER = 3
ALPHA = 0.4
SLICE_DOCS = 800  # documents of a slice, on average
TABLE_DOCS = 4_000 # documents for which there is one count table
SHORT_BITS = 3     # of a short number beyond those of the corpus' characters: some 2 % stand for two n-grams
ALL = np.uint64(0) # stands for all words


def _grams(w: Words, order: int) -> list[np.ndarray]:
    """For n = 1 to order, the hash of the n words that end at each word; 0 where a text has fewer before it."""
    place = np.arange(len(w.hash)) - np.repeat(np.cumsum(w.counts) - w.counts, w.counts)
    out = []
    for n in range(1, order + 1):
        g = np.zeros(len(w.hash), np.uint64)
        if len(w.hash) >= n:
            g[n - 1:] = w.windows(n) | np.uint64(1)
            g[place < n - 1] = 0
        out.append(g)
    return out


def packed(ascending: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as a first one and steps: the low bits of each as they are, the rest in unary."""
    steps = np.diff(ascending)
    low = max(int(steps.mean(dtype=float)).bit_length() - 1, 0) if len(steps) else 0
    rest = np.packbits(_unary((steps >> np.uint64(low)).astype(np.int64)))
    return bytes([low]) + np.array([len(steps), ascending[0]], "<u8").tobytes() + low_bits(steps, low) + rest.tobytes()


def _unary(numbers: np.ndarray) -> np.ndarray:
    ends = np.cumsum(numbers + 1) - 1
    out = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, bool)
    out[ends] = True
    return out


def unpacked(raw: bytes) -> np.ndarray:
    low, (n, first) = raw[0], np.frombuffer(raw, "<u8", 2, 1)
    n = int(n)
    wide = -(-low * n // 8)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, -1, 17 + wide)))[:n]
    steps = with_low_bits((np.diff(ends, prepend=-1) - 1).astype(np.uint64), raw[17: 17 + wide], np.uint64(low))
    return np.cumsum(np.concatenate([[first], steps]), dtype=np.uint64)


def low_bits(numbers: np.ndarray, count: np.uint64) -> bytes:
    """The lowest `count` bits of each number."""
    return np.packbits(np.concatenate([(numbers >> np.uint64(b) & np.uint64(1)).astype(bool) for b in range(count)] or [np.zeros(0, bool)])).tobytes()


def with_low_bits(high: np.ndarray, raw: bytes, count: np.uint64) -> np.ndarray:
    out, n = high << count, int(count) * len(high)
    for b, bits in enumerate(np.unpackbits(np.frombuffer(raw, np.uint8), count=n).reshape(int(count), len(high))):
        out |= bits.astype(np.uint64) << np.uint64(b)
    return out


def small(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 or more follow in eight."""
    large = counts[counts >= 255]
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype("<i8").tobytes()


def unsmall(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<i8", -1, n)
    return counts


def _text(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the shuffle."""
    for batch in batches:
        text = batch.column(1).cast(pa.large_binary())
        raw = [x.as_py() if x.is_valid else None for x in text]
        packed_up = [None if x is None else pa.compress(x, "zstd", asbytes=True) for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed_up, pa.binary()), pa.array([None if x is None else len(x) for x in raw], pa.int64()), batch.column(2)],
                                         ["doc_id", "raw", "size", "slice"])


def _texts(table: pa.Table) -> pa.Array:
    sizes = table.column("size").to_pylist()
    return pa.array([None if n is None else pa.decompress(x.as_py(), n, "zstd", asbytes=True) for x, n in zip(table.column("raw"), sizes)], pa.large_binary())


def lm_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_seen (words whose longest n-gram occurs in another document), score (mean log10)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_docs, n_chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    slices, tables = -(-n_docs // SLICE_DOCS) or 1, -(-n_docs // TABLE_DOCS) or 1
    spare = np.uint64(max(64 - int(n_chars).bit_length() - SHORT_BITS, 0))
    dealt = docs.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices))).mapInArrow(
        _squeezed, "doc_id long, raw binary, size long, slice long")

    def occurring(w: Words) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """A slice's distinct n-grams in ascending order, so those of one table are together; with counts, and each table's bounds."""
        grams = np.concatenate(_grams(w, order))
        distinct, n = np.unique(grams[grams != 0], return_counts=True)
        grams = np.concatenate([[ALL], distinct])
        at = ((grams >> np.uint64(32)) * np.uint64(tables) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(at, np.arange(tables + 1)).tolist()
        return grams, np.concatenate([[len(w.hash)], n]), list(zip(cuts, cuts[1:]))

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        grams, _, bounds = occurring(Words(*utf8(_texts(table))))
        rows = [(t, packed(grams[a:b] >> spare)) for t, (a, b) in enumerate(bounds) if b > a]
        return pa.table({"slice": pa.array([key[0].as_py()] * len(rows), pa.int64()), "part": pa.array([t for t, _ in rows], pa.int64()),
                         "short": pa.array([raw for _, raw in rows], pa.binary())})

    def mark(key: tuple, table: pa.Table) -> pa.Table:
        lists = [unpacked(raw.as_py()) for raw in _text(table, "short")]
        every = np.concatenate(lists)
        ends = np.cumsum([len(x) for x in lists])
        del lists
        by = np.argsort(every)
        every = every[by]
        same = every[1:] == every[:-1]
        shared = np.zeros(len(every), bool)
        shared[by] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        marks = [np.packbits(x).tobytes() for x in np.split(shared, ends[:-1])]
        return pa.table({"slice": table.column("slice"), "part": table.column("part"), "shared": pa.array(marks, pa.binary())})

    def ask(key: tuple, own: pa.Table, marks: pa.Table) -> pa.Table:
        grams, n, bounds = occurring(Words(*utf8(_texts(own))))
        shared = dict(zip(marks.column("part").to_pylist(), marks.column("shared").to_pylist()))
        rows = []
        for t, (a, b) in enumerate(bounds):
            if b > a:
                kept = (n[a:b] > 1) | np.unpackbits(np.frombuffer(shared[t], np.uint8), count=b - a).astype(bool) | (grams[a:b] == ALL)
                if kept.any():
                    rows.append((t, np.packbits(kept).tobytes(), low_bits(grams[a:b][kept], spare), small(n[a:b][kept])))
        return pa.table({"slice": pa.array([key[0].as_py()] * len(rows), pa.int64()), "part": pa.array([r[0] for r in rows], pa.int64())}
                        | {c: pa.array([r[k] for r in rows], pa.binary()) for k, c in ((1, "kept"), (2, "low"), (3, "n"))})

    def total(key: tuple, table: pa.Table, sketches: pa.Table) -> pa.Table:
        short = dict(zip(sketches.column("slice").to_pylist(), _text(sketches, "short")))
        lists = []
        for s, kept, low in zip(*(table.column(c).to_pylist() for c in ("slice", "kept", "low"))):
            high = unpacked(short[s].as_py())
            high = high[np.unpackbits(np.frombuffer(kept, np.uint8), count=len(high)).astype(bool)]
            lists.append(with_low_bits(high, low, spare))
        if not lists:
            return table.select(["slice", "part", "kept", "n"]).rename_columns(["slice", "part", "kept", "totals"])
        n = np.concatenate([unsmall(raw.as_py(), len(x)) for raw, x in zip(_text(table, "n"), lists)])
        ends = np.cumsum([len(x) for x in lists])
        every = np.concatenate(lists)
        del lists
        by = np.argsort(every)
        every = every[by]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        sums = np.zeros(len(every), np.int64)
        sums[by] = np.repeat(np.add.reduceat(n[by], first), np.diff(np.append(first, len(every))))
        answer = [small(x) for x in np.split(sums, ends[:-1])]
        return pa.table({"slice": table.column("slice"), "part": table.column("part"), "kept": table.column("kept"), "totals": pa.array(answer, pa.binary())})

    def score(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        w = Words(*utf8(_texts(own)))
        grams, n, bounds = occurring(w)
        totals = np.zeros(len(grams), np.int64)  # of those that weren't asked for: no other document has them
        for t, kept, raw in zip(*(answers.column(c).to_pylist() for c in ("part", "kept", "totals"))):
            a, b = bounds[t]
            at = a + np.flatnonzero(np.unpackbits(np.frombuffer(kept, np.uint8), count=b - a))
            totals[at] = unsmall(raw, len(at))
        words = float(totals[0]) - w.counts[w.text]

        def elsewhere(level: np.ndarray) -> np.ndarray:
            """How often each n-gram occurs outside the text it is in."""
            by = np.argsort(level, kind="stable")  # texts stay in order among equal ones
            g, text = level[by], w.text[by]
            new = np.concatenate([[True], g[1:] != g[:-1]])[: len(g)]
            runs = np.flatnonzero(new | np.concatenate([[True], text[1:] != text[:-1]])[: len(g)])
            mine = np.diff(np.append(runs, len(g)))
            found = np.maximum(totals[np.searchsorted(grams, g[runs])] - mine, 0)
            out = np.empty(len(g), np.int64)
            out[by] = np.repeat(found, mine)
            return np.where(level != 0, out, 0)

        levels = _grams(w, order)
        found = elsewhere(levels[0])
        p = np.where(found > 0, found / np.maximum(words, 1), ALPHA / (words + 1))
        seen = found > 0
        for level in levels[1:]:
            before = np.concatenate([[0], found])[: len(found)]  # the history is the shorter n-gram that ends one word earlier
            found = elsewhere(level)
            p = np.where(found > 0, found / np.maximum(before, 1), np.where(level != 0, ALPHA, 1.0) * p)
            seen = np.where(level != 0, found > 0, seen)
        logs = np.bincount(w.text, weights=np.log10(p), minlength=own.num_rows) if len(p) else np.zeros(own.num_rows)
        return pa.table({"doc_id": own.column("doc_id"), "n_words": pa.array(w.counts.astype(np.int64)),
                         "n_seen": pa.array(np.bincount(w.text[seen], minlength=own.num_rows).astype(np.int64)),
                         "score": pa.array(logs / np.maximum(w.counts, 1), mask=w.counts == 0)})

    by_slice = dealt.groupBy("slice")
    sketches = by_slice.applyInArrow(sketch, "slice long, part long, short binary")
    marks = sketches.groupBy("part").applyInArrow(mark, "slice long, part long, shared binary")
    asking = by_slice.cogroup(marks.groupBy("slice")).applyInArrow(ask, "slice long, part long, kept binary, low binary, n binary")
    answers = asking.groupBy("part").cogroup(sketches.groupBy("part")).applyInArrow(total, "slice long, part long, kept binary, totals binary")
    return by_slice.cogroup(answers.groupBy("slice")).applyInArrow(score, "doc_id long, n_words long, n_seen long, score double")
