"""Vectorised word and shingle hashing straight on Arrow string buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D; UTF-8 continuation bytes are never
in that set, so working on bytes equals working on characters.  Hashes are 64-bit and fixed: the
same word gives the same number in every task, session and machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): close inputs come out unrelated."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and n + 1 offsets into it; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]: offsets[-1]], offsets - offsets[0]


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BLOCK = 1 << 17  # bytes hashed at a time


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * BLOCK)
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            out = np.full(size, np.uint64(base), np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word, from running sums over blocks of whole words."""
    out = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):
        low = int(start[first])
        last = max(first + 1, int(np.searchsorted(end, low + BLOCK, side="right")))
        high = int(end[last - 1])
        forth, back = powers(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * forth, out=sums[1:])
        s, e = start[first:last] - low, end[first:last] - low
        out[first:last] = (sums[e] - sums[s]) * back[s]
        first = last
    return mix(out + (end - start).astype(np.uint64) * _STEPS[63])


class Words:
    """The words of many texts: `start`, `end` (bytes), `text` (its number), `hash`; sorted by position."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        if lower:
            data = LOWER[data]
        inside = ~SPACE[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        opens[heads] = inside[heads]  # a text's first byte never continues the text before
        self.start = np.flatnonzero(opens)
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        closes[heads[1:] - 1] = inside[heads[1:] - 1]
        self.end = np.flatnonzero(closes) + 1
        self.counts = np.diff(np.searchsorted(self.start, offsets))
        self.text = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.hash = span_hashes(data, self.start, self.end)

    def windows(self, size: int) -> np.ndarray:
        """The hash of the `size` words from each word on, whether or not they are of one text."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = self.hash[:n] * _STEPS[0]
        for j in range(1, size):
            total += self.hash[j: n + j] * _STEPS[j]
        return mix(total + np.uint64(size))

    def shingles(self, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every window of `size` words by text; a shorter text is one window of all its words."""
        n = len(self.hash)
        texts, hashes = [], []
        for k in range(min(size, n), 0, -1):
            if k < size and not (self.counts == k).any():
                continue
            fits = self.text[: n - k + 1] == self.text[k - 1:]
            if k < size:
                fits &= self.counts[self.text[: n - k + 1]] == k
            texts.append(self.text[: n - k + 1][fits])
            hashes.append(self.windows(k)[fits])
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if len(texts) == 1:
            return texts[0], hashes[0]
        text, hashed = np.concatenate(texts), np.concatenate(hashes)
        order = np.argsort(text, kind="stable")
        return text[order], hashed[order]


def slices(column: pa.Array, size: int = 2 << 20) -> list[tuple[int, int]]:
    """Row ranges of a column with some `size` bytes of text each, or one longer text."""
    _, offsets = utf8(column)
    out, first = [], 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        out.append((first, last))
        first = last
    return out


def distinct_sets(text: np.ndarray, hashed: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, ascending inside a text, and n_texts + 1 offsets."""
    first = np.searchsorted(text, np.arange(n_texts + 1))
    hashed = hashed.copy()
    for i in range(n_texts):  # `text` is ascending: each one's hashes are sorted where they are
        hashed[first[i]: first[i + 1]].sort()
    keep = np.ones(len(hashed), bool)
    keep[1:] = (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1])
    counts = np.bincount(text[keep], minlength=n_texts) if len(text) else np.zeros(n_texts, np.int64)
    return hashed[keep], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
