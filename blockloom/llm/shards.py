"""Places for documents, so that those with the same rare words come together.

A text is a set of hashed words with inverse document frequencies, projected to DIMENSIONS numbers.
Spherical k-means over a bounded sample gives each kind of document about as many centres as it needs
shards; the centres are numbered along their first principal direction, so that neighbouring places
are alike too.  `twin` is a weighted min-hash of the words: copies share it, wherever a place is cut.
The sample only steers the order of rows; what is found in a shard is scored exactly.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.words import Words, mix, slices, utf8

SAMPLE_DOCS = 8_000
CUT_DOCS = 8         # of the sample in a part at least
DIMENSIONS = 64
BUCKETS = 1 << 16
MOST_CENTRES = 256
TOKEN_BYTES = 4      # of text, about
STEPS = 15


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(64)).standard_normal((BUCKETS, DIMENSIONS), np.float32)


def bags(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct word buckets of each text."""
    for first, last in slices(texts):
        w = Words(*utf8(texts.slice(first, last - first)))
        bucket = (w.hash >> np.uint64(48)).astype(np.int64)
        for own in np.split(bucket, np.cumsum(w.counts)[:-1]):
            yield np.unique(own)


class Places:
    def __init__(self, kinds: list[str], found: list[np.ndarray], centres_of: dict[str, int]):
        n = len(found)
        df = np.bincount(np.concatenate(found), minlength=BUCKETS) if found else np.zeros(BUCKETS)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.idf[df < 2] = 0  # a word of one document brings nothing together
        chance = ((mix(np.arange(BUCKETS, dtype=np.uint64)) >> np.uint64(11)).astype(float) + 1) / 2**53
        self.cost = -np.log(chance) / np.maximum(self.idf, 1e-6) ** 2
        self.centres: dict[str, np.ndarray] = {}
        vectors = np.stack([self.vector(b) for b in found]) if found else np.zeros((0, DIMENSIONS), np.float32)
        names = np.array(kinds, object)
        for kind, k in centres_of.items():
            own = vectors[names == kind]
            if min(k, len(own)) > 1:
                self.centres[kind] = _centres(own, min(k, len(own)))

    def vector(self, bag: np.ndarray) -> np.ndarray:
        v = self.idf[bag] @ _directions()[bag]
        return v / max(float(np.linalg.norm(v)), 1e-9)

    def place(self, kind: str, bag: np.ndarray) -> tuple[int, int]:
        centres = self.centres.get(kind)
        at = 0 if centres is None else int(np.argmax(centres @ self.vector(bag)))
        return at, int(bag[np.argmin(self.cost[bag])]) if len(bag) else -1

    def cut(self, rows: list[tuple], parts: int) -> None:
        """Cuts between parts, from sorted rows (kind, place, twin, h, size).  More parts than CUT_DOCS rows allow
        lie within those of the cuts, by h."""
        ranges = max(min(parts, len(rows) // CUT_DOCS), 1)
        self.within = parts // ranges
        ends = np.cumsum([row[-1] for row in rows], dtype=float)
        at = np.searchsorted(ends, np.arange(1, ranges) / ranges * ends[-1]) if ranges > 1 else []
        self.cuts = [rows[k][:-1] for k in at]

    def part(self, kind: str, place: int, twin: int, h: int) -> int:
        return bisect_right(self.cuts, (kind, place, twin, h)) * self.within + h % self.within


def _centres(v: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(k))
    mean = v.mean(axis=0)
    c = v[rng.choice(len(v), k, replace=False)] - mean
    for _ in range(STEPS):
        at = np.argmax((v - mean) @ c.T, axis=1)
        c = np.stack([(v[at == j] - mean).mean(axis=0) if (at == j).any() else v[rng.integers(len(v))] - mean for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    along = np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0]
    return c[np.argsort(c @ along, kind="stable")]


def fit(docs: DataFrame, shard_tokens: int, parts: int = 1) -> Places:
    """From a sample of `docs` (doc_id, text, kind, h), drawn by a hash of the row; with cuts between `parts` parts of about equal bytes."""
    n = docs.count()
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("place")), F.lit(1_000_000)) * F.lit(n) < F.lit(1_000_000 * SAMPLE_DOCS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [b.astype(np.uint16).tobytes() for b in bags(batch.column(1))] if batch.num_rows else []
            sizes = np.diff(utf8(batch.column(1))[1]) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(raw, pa.binary()), pa.array(sizes, pa.int64())], ["kind", "h", "bag", "size"])

    got = drawn.select("kind", "text", "h").mapInArrow(run, "kind string, h long, bag binary, size long").toPandas().sort_values(["kind", "bag", "h"])
    whole = got.groupby("kind")["size"].sum() * (n / max(len(got), 1))
    centres_of = {kind: int(min(MOST_CENTRES, -(-size // (shard_tokens * TOKEN_BYTES)))) for kind, size in whole.items()}
    kinds, found = got["kind"].tolist(), [np.frombuffer(b, np.uint16).astype(np.int64) for b in got["bag"]]
    places = Places(kinds, found, centres_of)
    places.cut(sorted((k, *places.place(k, b), h, size + 1) for k, b, h, size in zip(kinds, found, got["h"].tolist(), got["size"].tolist())), parts)
    return places


def placed(docs: DataFrame, shard_tokens: int, parts: int) -> DataFrame:
    """`docs` (doc_id, text, kind, h) with `place` and `twin`, and with the one of `parts` parts in the order of kind,
    place, twin and h that a row is in."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, shard_tokens, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            kinds, h = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            got = [places.place(k, b) for k, b in zip(kinds, bags(batch.column(1)))] if batch.num_rows else []
            place, twin = zip(*got) if got else ((), ())
            part = [places.part(*row) for row in zip(kinds, place, twin, h)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int32()) for x in (place, twin, part))],
                                             ["doc_id", "text", "kind", "h", "place", "twin", "part"])

    return docs.mapInArrow(run, "doc_id long, text string, kind string, h long, place int, twin int, part int")
