"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a set of byte strings that holds every single byte.  A trie over it gets, for each
node, a failure link (where matching goes on after the longest pieces of the node's string are cut
off) and the number of pieces cut off on the way.  A word is then read once, byte by byte: no piece
is ever built, and no byte is looked at again beyond the links followed.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHED_WORDS = 200_000  # words remembered by a task; beyond that the memory starts anew


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file as bytes (its printable stand-ins turned back)."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as f:
        words = json.load(f)["model"]["vocab"]
    return [bytes(back[c] for c in w) for w in words if all(c in back for c in w)]


class Automaton:
    """Greedy longest-match counts.  The empty string has no pieces; every byte must be a piece."""

    def __init__(self, pieces: list[bytes]):
        goto: dict[int, int] = {}  # node * 256 + byte -> node
        final = [False]
        parent = [(0, 0)]
        for piece in pieces:
            node = 0
            for b in piece:
                step = goto.get(node * 256 + b)
                if step is None:
                    step = goto[node * 256 + b] = len(final)
                    final.append(False)
                    parent.append((node, b))
                node = step
            final[node] = True
        if any(b not in goto or not final[goto[b]] for b in range(256)):
            raise ValueError("every single byte must be a piece of the vocabulary")
        link, popped = [-1] * len(final), [0] * len(final)
        level = [goto[b] for b in range(256)]
        children: list[list[int]] = [[] for _ in final]
        for node in range(1, len(final)):
            children[parent[node][0]].append(node)
        while level:  # by depth: links of shorter strings come first
            for v in level:
                u, b = parent[v]
                if final[v]:
                    link[v], popped[v] = 0, 1
                    continue
                cut, z = popped[u], link[u]
                while z > 0 and z * 256 + b not in goto:
                    cut, z = cut + popped[z], link[z]
                link[v], popped[v] = goto[z * 256 + b], cut
            level = [c for v in level for c in children[v]]
        self.goto, self.link, self.popped = goto, link, popped

    def count(self, word: bytes) -> int:
        goto, link, popped = self.goto, self.link, self.popped
        node = total = 0
        for b in word:
            step = goto.get(node * 256 + b)
            while step is None:
                total += popped[node]
                node = link[node]
                step = goto.get(node * 256 + b)
            node = step
        while node:
            total += popped[node]
            node = link[node]
        return total


@lru_cache(maxsize=2)
def _automaton(path: str) -> Automaton:
    return Automaton(vocabulary(path))


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words, n_bytes, n_tokens of every whole text; null and empty texts have 0 of each.

    Words are split at space and 0x09-0x0D; a word is matched with one space before it, as byte-level
    vocabularies write word starts.  The file must be at the same path on every worker.  Rows
    repeat as they come and other columns are not looked at.
    """

    def counts(batches):
        automaton = _automaton(vocabulary_path)
        known: dict[bytes, int] = {}
        for texts in batches:
            rows = []
            for text in texts:
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                words, total = raw.split(), 0  # bytes split at exactly space and 0x09-0x0D
                for w in words:
                    n = known.get(w)
                    if n is None:
                        if len(known) >= CACHED_WORDS:
                            known.clear()
                        n = automaton.count(b" " + w)
                        if len(w) <= 64:
                            known[w] = n
                    total += n
                rows.append((len(words), len(raw), total))
            yield pd.DataFrame(rows, columns=["n_words", "n_bytes", "n_tokens"])

    shape = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_bytes", "n_tokens")])
    counted = F.pandas_udf(_typed(counts), shape)
    return docs.select("doc_id", counted(F.col("text").cast("string")).alias("c")).select("doc_id", "c.*")


def _typed(f):
    from collections.abc import Iterator

    f.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return f
