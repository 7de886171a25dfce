"""Packing of documents into training windows by lexical retrieval.

Documents are range-partitioned by language, content and a hash, so that a shard has documents that
belong together and any language or topic spreads over as many shards as it needs (`shards.py`).
Texts are turned into token ids, whole windows are cut off long documents, and the rest waits.  What
waits, up to the tokens that a task can hold, gets one inverted index with BM25 weights over all
terms; each window starts with the oldest waiting document, then takes its best-ranked unused
neighbours that fit, and is closed with the first part of the best one that doesn't.  What is left
moves on to the next index.  Only the tail of a partition is no whole window: it is cut at powers of two.

A null text counts as empty: one piece with just the end id.  Rows repeat as they come (each is packed);
a null doc_id stays null; other columns are not looked at.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.shards import placed
from blockloom.session import task_count

WINDOW = 2048
END = 1
SHARD_TOKENS = 1 << 24  # of waiting documents in one index: what a task can hold
WIDE = 8                # terms in more than one document of so many lie open in the index
HELD = 64               # tokens that a waiting document counts for at least
K1, B = 1.2, 0.75
CACHED_CHUNKS = 120_000
SHAPE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                   ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_UNEVEN = re.compile(r"\s\s")


class Ids:
    """Token ids of texts as 16-bit arrays, the same as the tokenizer file gives.

    The tokenizer never joins what stands on the two sides of a space between two other characters,
    so without ranks such texts are looked up chunk by chunk and only unseen chunks are encoded.  Texts with
    runs of white space, or with the string of a special token, are encoded whole, as all are where ranks are given.
    """

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        self.special = [t["content"] for t in given["added_tokens"]]
        if len(given["model"]["vocab"]) + len(self.special) > 1 << 16:
            raise ValueError("ids beyond 16 bits are not supported")
        del given
        self.path, self.loaded, self.fast = path, None, None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> list[int]:
        if self.loaded is None:  # with ranks at hand it is rarely needed
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_file(self.path)
        return self.loaded.encode(text, add_special_tokens=False).ids

    def _encode(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text) if self.fast else self._whole(text), np.uint16).tobytes()

    def __call__(self, text: str | None) -> np.ndarray:
        """The ids of a text with the end id after them."""
        if not text:
            return np.array([END], np.uint16)
        if any(s in text for s in self.special):
            return np.append(np.array(self._whole(text), np.uint16), np.uint16(END))
        if self.fast or _UNEVEN.search(text):
            return np.append(np.frombuffer(self._encode(text), np.uint16), np.uint16(END))
        chunks = text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]
        known, out = self.known, []
        for c in chunks:
            ids = known.get(c)
            if ids is None:
                if len(known) >= CACHED_CHUNKS:
                    known.clear()
                ids = self._encode(c)
                if len(c) <= 48:
                    known[c] = ids
            out.append(ids)
        out.append(END.to_bytes(2, "little"))
        return np.frombuffer(b"".join(out), "<u2")


@lru_cache(maxsize=1)
def _ids(path: str, ranks_path: str | None, pattern: str | None) -> Ids:
    return Ids(path, ranks_path, pattern)


class Index:
    """BM25 over a shard's documents, as postings sorted by term; used documents leave the postings.

    Scores add up every term that a seed shares with a document.  Weights are those of the whole
    shard, whatever has been used since.
    """

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        found = [np.unique(d, return_counts=True) for d in docs]
        self.own = [terms for terms, _ in found]
        term = np.concatenate(self.own)
        tf = np.concatenate([count for _, count in found]).astype(np.float32)
        del found
        self.doc = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in self.own])
        length = np.array([len(d) for d in docs], float)
        norm = (K1 * (1 - B + B * length / length.mean())).astype(np.float32)
        tf = tf * np.float32(K1 + 1) / (tf + norm[self.doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = self.doc[order], tf[order]
        df = np.bincount(term, minlength=1 << 16)
        del order, term, tf
        self.weight *= np.repeat(np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), df)
        self.alive = np.arange(n)  # the documents that still are in the postings
        self._lay_out(df)

    def _lay_out(self, df: np.ndarray) -> None:
        """Where each term's postings are; those of terms in many documents lie open, as whole rows."""
        self.first = np.concatenate([[0], np.cumsum(df)])
        wide = np.flatnonzero(df * WIDE > max(len(self.alive), 64))
        self.row = dict(zip(wide.tolist(), range(len(wide))))
        self.rows = np.zeros((len(wide), len(self.alive)), np.float32)
        for t, k in self.row.items():
            at = slice(self.first[t], self.first[t + 1])
            self.rows[k, self.doc[at]] = self.weight[at]

    def drop(self, unused: np.ndarray) -> None:
        """Leave used documents out of the postings, once they are a quarter of them."""
        keep = unused[self.alive]
        if keep.sum() * 4 > len(self.alive) * 3:
            return
        at = keep[self.doc]
        df = np.bincount(np.repeat(np.arange(1 << 16), np.diff(self.first))[at], minlength=1 << 16)
        self.doc, self.weight = (np.cumsum(keep, dtype=np.int32) - 1)[self.doc[at]].astype(np.int32), self.weight[at]
        self.alive = self.alive[keep]
        self._lay_out(df)

    def scores(self, seed: int) -> np.ndarray:
        """Of each document in `alive`, over all terms it shares with the seed."""
        score = np.zeros(len(self.alive), np.float32)
        for t in self.own[seed].tolist():
            if (k := self.row.get(t)) is not None:
                score += self.rows[k]
            else:
                at = slice(self.first[t], self.first[t + 1])
                score[self.doc[at]] += self.weight[at]
        return score

    def neighbours(self, seed: int) -> np.ndarray:
        """All documents in the postings, best first; ties in the shard's order."""
        return self.alive[np.argsort(-self.scores(seed), kind="stable")]


class Packer:
    """Turns a stream of documents into rows of pieces."""

    def __init__(self, shard: int):
        self.next_id = shard << 40
        self.pool: deque = deque()  # (doc_id, ids, start): what is left of each document
        self.held = 0               # tokens in the pool
        self.rows: list[tuple] = []

    def _piece(self, doc, ids, start, length, offset):
        crc = zlib.crc32(ids[start: start + length].astype("<u4").tobytes())
        self.rows.append((doc, start, length, crc, len(ids), self.next_id, offset))

    def add(self, doc, ids: np.ndarray) -> None:
        start = 0
        while len(ids) - start >= WINDOW:
            self._piece(doc, ids, start, WINDOW, 0)
            self.next_id += 1
            start += WINDOW
        if start < len(ids):
            self.pool.append((doc, ids, start))
            self.held += max(len(ids) - start, HELD)
            if self.held >= SHARD_TOKENS:
                self.fill()

    def fill(self) -> None:
        """Whole windows out of the pool; what stays is less than one window."""
        waiting = list(self.pool)
        left = np.array([len(ids) - start for _, ids, start in waiting])
        start = np.array([s for _, _, s in waiting])
        index = Index([ids[s:] for _, ids, s in waiting])
        total, seed = int(left.sum()), 0
        while total >= WINDOW:
            while not left[seed]:
                seed += 1
            index.drop(left > 0)
            alive, score = index.alive, index.scores(seed)
            size = left[alive]
            score[size == 0] = -1
            room, offset, take, at = WINDOW, 0, seed, int(np.searchsorted(alive, seed))
            while True:
                doc, ids, _ = waiting[take]
                length = int(min(left[take], room))
                self._piece(doc, ids, int(start[take]), length, offset)
                start[take] += length
                left[take] -= length
                score[at] = -1
                room, offset = room - length, offset + length
                if not room:
                    break
                fits = np.where(size <= room, score, np.float32(-1))
                at = int(np.argmax(fits))
                if fits[at] < 0:
                    at = int(np.argmax(score))
                take = int(alive[at])
            self.next_id += 1
            total -= WINDOW
        self.pool = deque((doc, ids, int(start[i])) for i, (doc, ids, _) in enumerate(waiting) if left[i])
        self.held = sum(max(len(ids) - s, HELD) for _, ids, s in self.pool)

    def finish(self) -> None:
        """The tail: sequences of a power of two each."""
        while sum(len(ids) - s for _, ids, s in self.pool) >= WINDOW:
            self.fill()
        total = sum(len(ids) - s for _, ids, s in self.pool)
        while total:
            size, offset = 1 << (total.bit_length() - 1), 0
            total -= size
            while offset < size:
                doc, ids, s = self.pool.popleft()
                length = min(len(ids) - s, size - offset)
                self._piece(doc, ids, s, length, offset)
                offset += length
                if s + length < len(ids):
                    self.pool.appendleft((doc, ids, s + length))
            self.next_id += 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) if rows else [[]] * len(SHAPE)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SHAPE)], schema=SHAPE)


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None,
         shard_by: tuple[str, ...] = ("lang",)) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece.

    `ranks_path` with `pattern` may name the same vocabulary as ranks, for a faster encoder with the
    same ids.  `shard_by` are columns that documents of a window should share.
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in shard_by if c in docs.columns]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                    F.concat_ws("\x1f", *keys).alias("kind"))
    parts = task_count(docs.sparkSession)
    # the parts come with the places: a range partitioning would place every text once more to find its own
    d = placed(d.withColumn("h", F.xxhash64("doc_id", "text")), SHARD_TOKENS, parts).repartitionById(parts, "part")
    # one order of rows whichever way blocks arrive, so that a repeated task gives the same pieces
    d = d.sortWithinPartitions("kind", "place", "twin", "h", "doc_id").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids(tokenizer_path, ranks_path, pattern)
        packer = Packer(TaskContext.get().partitionId())
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, encode(text.as_py()))
                if len(packer.rows) >= 50_000:
                    yield packer.batch()
        packer.finish()
        yield packer.batch()

    return d.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
