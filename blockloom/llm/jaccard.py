"""Exact n-gram Jaccard self-join with parity sketches.

A document is the set of its five-word shingles.  Sets of Jaccard similarity 0.75 or more differ in at most a
seventh of their summed sizes.  The parity sketch of a set is the XOR of its members' hash words, kept in
parts: the shingle space is cut into equal ranges, and a range's word is the XOR of the members in it.
Each differing shingle changes one part, so of more non-empty parts than that bound at least one agrees.

1.  A size band has its own number of parts, so parts hold one or two shingles; a document near the upper end of
    its band also takes part in the next.  It gives out as many parts as its bound plus one, those
    first that a bounded sample doesn't show to be frequent.  A document with too few non-empty
    parts also gives out single shingles, by which any two such documents meet.
2.  Documents that share a part meet.  Sizes and sketches in which each shingle flips one bit - their
    Hamming distance never exceeds the sets' difference - discard most pairs.  Groups with the same members
    are compared once; large ones in blocks against blocks, so no task holds a whole group.
3.  The rest is verified on the shingle sets themselves, again in blocks, and only between documents
    that aren't connected yet: what comes out is links enough for the same components.

Exact copies of a set are one class throughout.  Rows with an empty set link with nothing.  A null
doc_id belongs to its class but names no component; rows that share a doc_id count as one document.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.llm.components import components
from blockloom.llm.idfilter import filter_of, held, spots
from blockloom.llm.words import Words, distinct_sets, mix, slices, utf8
from blockloom.session import RUNTIME_FILTERS, materialise, prepare

SIMILARITY = 75            # percent
SAMPLE_DOCS = 20_000       # documents in the sample that shows frequent parts: it steers order, not results
FREQUENT = 3               # of them that share a part
COARSE = 2                 # bits of a sketch for each shingle
FINE = 16                  # the same, where sets are at hand
BLOCK_MEMBERS = 400        # of a group in one block
BLOCK_SHINGLES = 1_000_000 # of a component in one block
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def bound(a, b):
    """The largest symmetric difference of two sets of these sizes that are linked."""
    return (a + b) * (100 - SIMILARITY) // (100 + SIMILARITY)


def linked(shared, a, b):
    return 100 * shared >= SIMILARITY * (a + b - shared)


def width(n: int, per: int) -> int:
    """Bits of the sketch of a set of n: a power of two, at least `per` * n and 512."""
    return max(512, 1 << (per * n - 1).bit_length())


def sketch_of(own: np.ndarray, bits: int) -> np.ndarray:
    """Parity bits of a set in 64-bit words; half as many bits are the XOR of the two halves."""
    spot = ((own * _B) >> np.uint64(20)).astype(np.int64) & (bits - 1)
    parity = (np.bincount(spot, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.uint64)


def _salt(n: int) -> np.uint64:
    return np.uint64((n + 1) * int(_C) & (1 << 64) - 1)


def keys_of(own: np.ndarray, frequent: np.ndarray, everything: bool = False) -> np.ndarray:
    """What a document gives out: hashes of (band, part, parity word), or of single shingles."""
    n = len(own)
    band = n.bit_length() - 1
    most = 4 * n // 3
    out = []
    schemes = [(band, bound(n, min(most, (2 << band) - 1)))]
    if most >= 2 << band:
        schemes.append((band + 1, bound(n, most)))
    for scheme, differ in schemes:
        bits = scheme if scheme >= 6 else scheme + 3
        part = own >> np.uint64(64 - bits)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        word = np.bitwise_xor.reduceat(own, first)
        keys = mix(word + part[first] * _A + _salt(scheme))
        out.append(_rarest(keys, frequent, len(keys) if everything else differ + 1))
        if len(first) <= differ:
            keys = mix(own + _salt(scheme + 64))
            out.append(_rarest(keys, frequent, len(keys) if everything else differ + 1))
    return np.concatenate(out)


def _rarest(keys: np.ndarray, frequent: np.ndarray, n: int) -> np.ndarray:
    keys = keys >> np.uint64(1)
    if n >= len(keys):
        return keys
    if len(frequent):
        at = np.searchsorted(frequent, keys)
        at[at == len(frequent)] = 0
        keys = keys | ((frequent[at] == keys).astype(np.uint64) << np.uint64(63))
    return np.partition(keys, n - 1)[:n] & np.uint64((1 << 63) - 1)


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(texts)
    text, hashed = Words(data, offsets).shingles()
    return distinct_sets(text, hashed, len(offsets) - 1)


def _identity(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set; 0 for an empty one."""
    out = []
    for factor in (_A, _C):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes * factor))])
        out.append(mix(sums[offsets[1:]] - sums[offsets[:-1]]))
    return out[0], out[1]


ROW = T.StructType([T.StructField("key", T.LongType()), T.StructField("sid", T.LongType()), T.StructField("doc", T.BinaryType())])


def _give_out(docs: DataFrame, frequent) -> DataFrame:
    """key, sid rows for the parts, and a row with `doc` for each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column(1)):
                hashes, offsets = _sets(batch.column(1).slice(first, last - first))
                sid, other = _identity(hashes, offsets)
                sketch = [sketch_of(own, width(len(own), COARSE)).tobytes() for own in np.split(hashes, offsets[1:-1])]
                ids = batch.column(0).slice(first, last - first).to_pylist()
                keys, owners, seen = [], [], set()
                for i in range(len(ids)):
                    own = hashes[offsets[i]: offsets[i + 1]]
                    if len(own) and (mark := (sid[i], other[i])) not in seen:
                        seen.add(mark)
                        keys.append(keys_of(own, frequent.value))
                        owners.append(np.full(len(keys[-1]), sid[i], np.uint64))
                docs_out = [struct.pack("<?qqq", d is not None, d or 0, int(offsets[i + 1] - offsets[i]), int(other[i].astype(np.int64))) + sketch[i] for i, d in enumerate(ids)]
                k = np.concatenate([*keys, mix(sid + _B)]).view(np.int64)
                o = np.concatenate([*owners, sid]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(o), pa.array([None] * (len(k) - len(ids)) + docs_out, pa.binary())], ["key", "sid", "doc"])

    return docs.mapInArrow(run, ROW)


def _frequent(docs: DataFrame) -> np.ndarray:
    """Parts that FREQUENT documents of a bounded sample share, ascending."""
    n = docs.count()
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("frequent")), F.lit(1_000_000)) * F.lit(n) < F.lit(1_000_000 * SAMPLE_DOCS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column(1)):
                hashes, offsets = _sets(batch.column(1).slice(first, last - first))
                found = [keys_of(hashes[a:b], np.zeros(0, np.uint64), True) for a, b in zip(offsets[:-1], offsets[1:]) if b > a]
                keys, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(count)], ["key", "n"])

    got = drawn.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).select("key").toArrow()
    return np.sort(got.column("key").to_numpy().astype(np.int64).view(np.uint64))


MET = "gid long, size long, sid long, doc_id long, n long, other long, sketch binary"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: (gid, size, sid) of each key that several sets share, and the documents."""
    held_key, held = None, []

    def emit(groups: list[np.ndarray], docs: list) -> pa.RecordBatch:
        size = np.array([len(g) for g in groups], np.int64)
        member = np.concatenate(groups) if groups else np.zeros(0, np.int64)
        gid = np.array([int(np.add.reduce(mix(g.view(np.uint64) + _A))) & (2**63 - 1) for g in groups], np.int64)
        none = [None] * len(member)
        d = list(zip(*docs)) if docs else [[]] * 5
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(gid, size).tolist() + [None] * len(docs), pa.int64()), pa.array(np.repeat(size, size).tolist() + [None] * len(docs), pa.int64()),
            pa.array(member.tolist() + list(d[0]), pa.int64()), pa.array(none + list(d[1]), pa.int64()), pa.array(none + list(d[2]), pa.int64()),
            pa.array(none + list(d[3]), pa.int64()), pa.array(none + list(d[4]), pa.binary())], ["gid", "size", "sid", "doc_id", "n", "other", "sketch"])

    done: set[int] = set()  # groups with the same members, given out by this task
    for batch in batches:
        key, sid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        payload = batch.column(2)
        is_doc = payload.is_valid().to_numpy(zero_copy_only=False)
        docs = []
        for s, raw in zip(sid[is_doc].tolist(), payload.filter(payload.is_valid()).to_pylist()):
            there, doc, n, other = struct.unpack("<?qqq", raw[:25])
            docs.append((s, doc if there else None, n, other, raw[25:]))
        key, sid = key[~is_doc], sid[~is_doc]
        groups = []
        if len(key):
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])])
            key, sid = key[new], sid[new]  # copies of a set give out the same rows
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            last = np.append(first[1:], len(key))
            if held_key is not None and key[0] != held_key:
                groups.append(np.unique(np.concatenate(held)))
                held_key, held = None, []
            if held_key is not None:
                held.append(sid[: last[0]])
                first, last = first[1:], last[1:]
                if len(first):
                    groups.append(np.unique(np.concatenate(held)))
                    held_key, held = None, []
            if len(first):
                held_key, held = key[first[-1]], [sid[first[-1]: last[-1]]]
                for g in np.flatnonzero(last[:-1] - first[:-1] > 1):
                    groups.append(sid[first[g]: last[g]])
        fresh = []
        for g in groups:
            if len(g) > 1 and (mark := hash(g.tobytes())) not in done:
                if len(done) >= 1_000_000:
                    done.clear()
                done.add(mark)
                fresh.append(g)
        if fresh or docs:
            yield emit(fresh, docs)
    if held_key is not None and len(g := np.unique(np.concatenate(held))) > 1:
        yield emit([g], [])


def _blocks(members: DataFrame, size, capacity: int) -> DataFrame:
    """Each row once for every pair of blocks it is needed in: columns b1 <= b2."""
    count = F.greatest(F.lit(1), F.ceil(size / F.lit(capacity))).cast("int")
    d = members.withColumn("_count", count).withColumn("_block", F.pmod(F.xxhash64("sid"), F.col("_count")).cast("int"))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    return d.withColumn("b1", F.least("_block", "_other")).withColumn("b2", F.greatest("_block", "_other")).drop("_count", "_other")


class Forest:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, whole, many small runs at a time; rows come sorted by the keys."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        last = np.ones(batch.num_rows, bool)
        for c in columns:
            last &= c == c[-1]
        cut = batch.num_rows - int(last[::-1].argmin() if not last.all() else batch.num_rows)
        same = bool(rest) and all(rest[-1].column(k)[rest[-1].num_rows - 1].as_py() == batch.column(k)[0].as_py() for k in keys)
        if cut == 0 and same:
            rest.append(batch)
            continue
        head = batch.slice(0, cut)
        if rest or cut:
            yield pa.Table.from_batches([*rest, head])
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def _close(n: np.ndarray, sketch: list[np.ndarray], block: np.ndarray, b1: int, b2: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, others, distance) for the pairs that sizes and sketches allow; across blocks where there are two.

    Partners of a set are no smaller than it, so their sketches are folded to its width.
    """
    order = np.argsort(n, kind="stable")
    size = n[order]
    upto = np.searchsorted(size, size * 100 // SIMILARITY, side="right")
    words = np.array([len(sketch[k]) for k in order])
    matrices: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in range(len(order) - 1):
        if upto[i] <= i + 1:
            continue
        w = int(words[i])
        if w not in matrices:
            at = np.flatnonzero((words == w) | (words == 2 * w))
            rows = [sketch[order[k]] if words[k] == w else sketch[order[k]][:w] ^ sketch[order[k]][w:] for k in at]
            place = np.full(len(order), -1)
            place[at] = np.arange(len(at))
            matrices[w] = np.stack(rows), place
        rows, place = matrices[w]
        other = np.arange(i + 1, upto[i])
        if b1 != b2:
            other = other[block[order[other]] != block[order[i]]]
        if len(other):
            far = np.bitwise_count(rows[place[other]] ^ rows[place[i]]).sum(axis=1, dtype=np.int64)
            near = far <= bound(size[other] + size[i], 0)
            if near.any():
                yield int(order[i]), order[other[near]], far[near]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of documents that may be similar, without those that earlier ones imply."""
    keys, forest = ["gid", "b1", "b2"], Forest()
    for table in _runs(batches, keys):
        starts = _starts(table, keys)
        rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        sketch = table.column("sketch")
        block, b1, b2 = (table.column(c).to_numpy() for c in ("_block", "b1", "b2"))
        out = []
        for s, e in zip(starts[:-1], starts[1:]):
            if e - s < 2:
                continue
            own = [np.frombuffer(x.as_py(), np.uint64) for x in sketch.slice(s, e - s)]
            for i, others, _ in _close(n[s:e], own, block[s:e], b1[s], b2[s]):
                a = int(rep[s + i])
                for b in rep[s + others].tolist():
                    if forest.join(a, b):
                        out.append((a, b))
        if len(forest.parent) > 2_000_000:
            forest = Forest()  # forgetting only repeats links
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """True links (a, b) within each pair of blocks, between documents not yet connected; the pairs of one
    set at a time, nearest first."""
    keys = ["component", "b1", "b2"]
    for table in _runs(batches, keys):
        starts = _starts(table, keys)
        rep, block, b1, b2 = (table.column(c).to_numpy() for c in ("rep", "_block", "b1", "b2"))
        raw = table.column("set")
        out = []
        for s, e in zip(starts[:-1], starts[1:]):
            if e - s < 2:
                continue
            own = [np.frombuffer(x.as_py(), np.uint64) for x in raw.slice(s, e - s)]
            n = np.array([len(x) for x in own])
            sketch = [sketch_of(x, width(len(x), FINE)) for x in own]
            forest = Forest()
            for i, others, far in _close(n, sketch, block[s:e], b1[s], b2[s]):
                for j in others[np.argsort(far, kind="stable")].tolist():
                    if forest.root(i) != forest.root(j):
                        both = np.concatenate([own[i], own[j]])
                        both.sort()
                        if linked(int((both[1:] == both[:-1]).sum()), n[i], n[j]):
                            forest.join(i, j)
                            out.append((rep[s + i], rep[s + j]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])


def _needed_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, sid, set of the documents in `wanted` (and a few others, which the join after this drops).

    The filter is looked up in the same Python node: a second one would hold a second worker for each core, and
    executors keep idle workers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(wanted, "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(held(shared.value, batch.column(2).to_numpy(), batch.column(3).to_numpy())))
            for first, last in slices(batch.column(1)):
                hashes, offsets = _sets(batch.column(1).slice(first, last - first))
                sid, _ = _identity(hashes, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(sid.view(np.int64)),
                                                  pa.array([hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], ["doc_id", "sid", "set"])

    known = docs.where(F.col("doc_id").isNotNull())
    return known.select("doc_id", "text", *spots(F.col("doc_id"))).mapInArrow(run, "doc_id long, sid long, set binary")


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (least doc_id with the same set), a row per document."""
    spark = docs.sparkSession
    prepare(spark)
    spark.conf.set(RUNTIME_FILTERS, "false")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    given = _give_out(docs, spark.sparkContext.broadcast(_frequent(docs)))
    met = materialise(given.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(_meet, MET))
    rows = met.where(F.col("gid").isNull())
    classes = materialise(rows.groupBy("sid", "other").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch")))
    named = classes.where(F.col("rep").isNotNull() & (F.col("n") > 0))
    members = met.where(F.col("gid").isNotNull()).groupBy("gid", "sid").agg(F.max("size").alias("size")).join(named, "sid")
    compared = _blocks(members.select("gid", "sid", "size", "rep", "n", "sketch"), F.col("size"), BLOCK_MEMBERS) \
        .repartition("gid", "b1", "b2").sortWithinPartitions("gid", "b1", "b2", "rep", "sid")
    coarse = materialise(components(compared.mapInArrow(_candidates, "a long, b long")))
    near = coarse.join(named, F.col("node") == F.col("rep")).select("component", "rep", "sid", "n")
    weight = near.groupBy("component").agg(F.sum("n").alias("weight"))
    sets = _needed_sets(docs, near.select("rep").distinct())
    heavy = near.join(weight, "component").join(sets.withColumnRenamed("sid", "s"), (F.col("rep") == F.col("doc_id")) & (F.col("sid") == F.col("s")))
    blocks = _blocks(heavy.select("component", "weight", "rep", "sid", "set"), F.col("weight"), BLOCK_SHINGLES) \
        .repartition("component", "b1", "b2").sortWithinPartitions("component", "b1", "b2", "rep", "sid")
    several = rows.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).where("x <> y").select("doc_id")
    one_id = rows.join(several, "doc_id", "left_semi").join(classes.select("sid", "other", "rep"), ["sid", "other"]) \
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(blocks.mapInArrow(_verified, "a long, b long").unionByName(one_id))
    named_class = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("sid").alias("s"), F.col("other").alias("o"), F.col("rep"), F.coalesce("component", "rep").alias("c"))
    whole = rows.where("n > 0").join(named_class, (F.col("sid") == F.col("s")) & (F.col("other") == F.col("o"))).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.col("rep").alias("class_id"))
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return whole.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component: the one with its least doc_id, and of rows that share that, any one.

    Rows without words are kept; rows without a doc_id too, as nothing names their component.
    """
    gone = similar(docs).where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    return left.where(F.col("doc_id").isNull()).unionByName(left.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]))
