"""SHA-256 of one long ordered document per group, without holding the document anywhere.

The protocol hashes a block as one JSON text over all its rows in a fixed order.  Rendering and
sorting run in parallel: rows are range-partitioned by (group, order), so one huge block spans
many tasks.  A group that begins and ends inside a task is hashed there; of groups that a task
border cuts every sorted batch leaves as one text chunk, and only these chunks then stream, in
order, through the hash of their group.  SHA-256 itself cannot be split, so that last pass is
one stream per group with constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.session import part_count

ORDER = ["n1", "n2", "s1", "s2", "s3", "s4"]
CHUNK = "block_index bigint, kind string, part int, run bigint, seq bigint, text string"
DONE = -1  # part of a row whose text is the hash of its whole group
KEPT_CHARS = 32 << 20  # most text of one group that waits for its end; a longer group leaves as chunks
SEPARATOR = "\x00"  # JSON text never holds a raw NUL
TAIL = 1_000_000


@dataclass(frozen=True)
class Segment:
    """One array of the document: text before and after it, and the height it exists from."""
    part: int
    before: str
    after: str
    active_from: int | None = 0  # None: never


@dataclass(frozen=True)
class Layout:
    kind: str
    segments: tuple[Segment, ...]
    numbered: bool = False  # rows become "0": row, "1": row, ... instead of an array


def fragments(df: DataFrame, kind: str, part: int, shown: list[Column | str], numbers: list[Column | str] = (),
              texts: list[Column | str] = (), late: bool = False) -> DataFrame:
    """Rows of one array as JSON fragments with their sort keys; `df` carries `block_index`.  The text of `late` rows
    follows from their sort keys: it isn't shuffled, `hash_documents` renders it where the rows lie sorted."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    keys = {f"n{i + 1}": as_col(c).cast("bigint") for i, c in enumerate(numbers)}
    keys.update({f"s{i + 1}": as_col(c).cast("string") for i, c in enumerate(texts)})
    order = [keys.get(k, F.lit(None).cast("bigint" if k[0] == "n" else "string")).alias(k) for k in ORDER]
    row = F.to_json(F.struct(*[as_col(c) for c in shown]), {"ignoreNullFields": "false"})
    return df.select(F.col("block_index").cast("bigint").alias("block_index"), F.lit(kind).alias("kind"),
                     F.lit(part).alias("part"), *order, (F.lit(None).cast("string") if late else row).alias("row"))


def tails(df: DataFrame, kind: str, text: Column) -> DataFrame:
    """Closing text of each group; every group to be hashed needs exactly one."""
    empty = [F.lit(None).cast("bigint" if k[0] == "n" else "string").alias(k) for k in ORDER]
    return df.select(F.col("block_index").cast("bigint").alias("block_index"), F.lit(kind).alias("kind"),
                     F.lit(TAIL).alias("part"), *empty, text.alias("row"))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(block_index, kind, part, text) of each stretch of sorted rows that one batch holds."""
    for pdf in batches:
        if not len(pdf):
            continue
        head = (pdf["block_index"].diff() != 0) | (pdf["kind"] != pdf["kind"].shift()) | (pdf["part"].diff() != 0)
        starts = [i for i, h in enumerate(head.to_numpy()) if h] + [len(pdf)]
        rows, block, kind, part = pdf["row"].to_numpy(), pdf["block_index"].to_numpy(), pdf["kind"].to_numpy(), pdf["part"].to_numpy()
        for a, b in zip(starts, starts[1:]):
            yield block[a], kind[a], part[a], SEPARATOR.join(rows[a:b])


def _chunks(layouts: dict[str, Layout] | None):
    """Chunks of sorted rows; with `layouts`, the hash instead of a group that the task surely holds whole: its first
    group may have begun in an earlier task, its last one may go on in a later one."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seq, out, size = TaskContext.get().partitionId(), 0, [], 0
        current, doc, kept, waiting, first = None, None, [], 0, True
        for block, kind, part, text in _pieces(batches):
            if (block, kind) != current:
                first, current, kept, waiting = current is None, (block, kind), [], 0  # a group without a tail has no hash
                doc = None if first or layouts is None else _Document(layouts[kind], int(block))
            piece = (block, kind, part, at, seq, text)
            seq += 1
            if doc is None:
                out.append(piece)
                size += len(text)
            elif part == TAIL:
                out.append((block, kind, DONE, at, seq, doc.close(text)))
                kept, waiting = [], 0
            else:
                doc.rows(int(part), text)
                kept.append(piece)
                waiting += len(text)
                if waiting > KEPT_CHARS:
                    out, size, doc, kept = out + kept, size + waiting, None, []
            if len(out) >= 1_000 or size > 1 << 20:
                yield pd.DataFrame(out, columns=["block_index", "kind", "part", "run", "seq", "text"])
                out, size = [], 0
        if out or kept:
            yield pd.DataFrame(out + kept, columns=["block_index", "kind", "part", "run", "seq", "text"])
    return run


class _Document:
    """Running hash of one group: opens and closes segments as chunks of rising parts arrive."""

    def __init__(self, layout: Layout, height: int):
        self.sha = hashlib.sha256()
        self.numbered = layout.numbered
        self.segments = [s for s in layout.segments if s.active_from is not None and height >= s.active_from]
        self.at, self.rows_written, self.count = -1, False, 0
        if self.numbered:
            self.sha.update(b"{")

    def _advance(self, part: int | None) -> bool:
        while self.at < len(self.segments) and (self.at < 0 or part is None or self.segments[self.at].part < part):
            if self.at >= 0:
                self.sha.update(self.segments[self.at].after.encode())
            self.at += 1
            self.rows_written = False
            if self.at < len(self.segments):
                self.sha.update(self.segments[self.at].before.encode())
        return self.at < len(self.segments) and self.segments[self.at].part == part

    def rows(self, part: int, text: str) -> None:
        if self.numbered:
            for row in text.split(SEPARATOR):
                self.sha.update(f'"{self.count}":{row},'.encode())
                self.count += 1
            return
        if not self._advance(part):
            return  # segment not active at this height
        if self.rows_written:
            self.sha.update(b",")
        self.sha.update(text.replace(SEPARATOR, ",").encode())
        self.rows_written = True

    def close(self, tail: str) -> str:
        if not self.numbered:
            self._advance(None)
        self.sha.update(tail.encode())
        return self.sha.hexdigest()


def _hasher(layouts: dict[str, Layout], seeds: dict[str, str] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, current, last = None, None, dict(seeds or {})
        for pdf in batches:
            out = []
            for block, kind, part, text in zip(pdf["block_index"], pdf["kind"], pdf["part"], pdf["text"]):
                if part == DONE:
                    out.append((block, kind, text))
                    continue
                if (block, kind) != current:
                    doc, current = _Document(layouts[kind], int(block)), (block, kind)
                if part != TAIL:
                    doc.rows(int(part), text)
                    continue
                if seeds is not None:
                    text = text.replace("%PREVIOUS%", last.get(kind, ""))
                last[kind] = doc.close(text)
                out.append((block, kind, last[kind]))
            if out:
                yield pd.DataFrame(out, columns=["block_index", "kind", "hash"])
    return run


def hash_documents(rows: DataFrame, layouts: list[Layout], seeds: dict[str, str] | None = None, late: Column | None = None) -> DataFrame:
    """(block_index, kind, hash) of every group that has a tail row.

    With `seeds` the groups of a kind form a chain in height order, each tail holding
    `%PREVIOUS%` where the hash before it goes; a chain is serial by definition, so use it on a
    window of new blocks.  `late` is the text, over the sort keys, of rows that have none yet.
    """
    by_kind = {layout.kind: layout for layout in layouts}
    tasks = part_count(rows, 2)  # grows with the input, so what a task sorts doesn't
    ranged = rows.repartitionByRange(tasks, "block_index", "kind", "part", *ORDER, "row").sortWithinPartitions(
        "block_index", "kind", "part", *ORDER, "row")
    text = F.col("row") if late is None else F.coalesce("row", late).alias("row")
    chunks = ranged.select("block_index", "kind", "part", text).mapInPandas(_chunks(None if seeds is not None else by_kind), CHUNK)
    group = ["kind"] if seeds is not None else ["block_index", "kind"]
    first = ["kind", "block_index"]
    ordered = chunks.repartition(tasks, *group).sortWithinPartitions(*first, "part", "run", "seq")
    return ordered.select("block_index", "kind", "part", "text").mapInPandas(
        _hasher(by_kind, seeds), "block_index bigint, kind string, hash string")
