"""A sparse Merkle tree kept as stored nodes: updates write only the paths that change.

Nodes are content-addressed and never change, so versions share what they have in common.  A node is a branch
(hashes of its two children) or stands for a lone leaf with empty subtrees around it (key and leaf), so a leaf costs
about two nodes, not one per level.  The tree is laid out by key prefix: an update reads the stored nodes of the
touched prefixes only, one group per prefix, and writes new nodes and the prefixes' new roots.  Roots are a table of
the version log, so a version of the tree appears at once; nodes written before a crash are orphans and harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.fixed_values import SMT_DEPTH
from blockloom.functions import canon
from blockloom.operators import smt
from blockloom.session import task_count
from blockloom.sources import versions
from blockloom.sources.versions import Delta, Staged

NODE = "head string, prefix string, node_hash string, left_hash string, right_hash string, key string, leaf string"
ROOTS = "smt_roots"
HEAD_DIGITS = 2  # hex digits of a prefix that name a folder of nodes


class Nodes:
    """Nodes of one prefix by hash: (left, right) of a branch, or (key, leaf) of a lone leaf; `fresh` are new ones."""

    def __init__(self, branches: dict[bytes, tuple[bytes, bytes]], lone: dict[bytes, tuple[bytes, bytes]]):
        self.branches, self.lone, self.fresh = branches, lone, {}

    def updated(self, node: bytes, depth: int, changes: list[tuple[bytes, bytes | None]]) -> bytes:
        """The root of the subtree `node` after changes sorted by key; a leaf of None goes away."""
        if not changes:
            return node
        if node == canon.EMPTY_ROOTS[SMT_DEPTH - depth]:
            return self.built([c for c in changes if c[1] is not None], depth)
        if node in self.lone:
            entries = dict([self.lone[node]]) | dict(changes)
            return self.built(sorted((k, v) for k, v in entries.items() if v is not None), depth)
        if node not in self.branches:
            raise ValueError(f"node {node.hex()} is not stored")
        left, right = self.branches[node]
        mid = next((i for i, (k, _) in enumerate(changes) if smt._bit(k, depth)), len(changes))
        return self.joined(self.updated(left, depth + 1, changes[:mid]), self.updated(right, depth + 1, changes[mid:]), depth)

    def built(self, entries: list[tuple[bytes, bytes]], depth: int) -> bytes:
        if not entries:
            return canon.EMPTY_ROOTS[SMT_DEPTH - depth]
        if len(entries) == 1:
            node = smt.lifted(*entries[0], depth)
            self.lone[node] = self.fresh[node] = entries[0]
            return node
        mid = next((i for i, (k, _) in enumerate(entries) if smt._bit(k, depth)), len(entries))
        return self.joined(self.built(entries[:mid], depth + 1), self.built(entries[mid:], depth + 1), depth)

    def joined(self, left: bytes, right: bytes, depth: int) -> bytes:
        empty = canon.EMPTY_ROOTS[SMT_DEPTH - depth - 1]
        if left == right == empty:
            return canon.EMPTY_ROOTS[SMT_DEPTH - depth]
        node = canon.pair_digest(left, right)
        only = left if right == empty else right if left == empty else None
        if only is not None and only in self.lone:
            if node not in self.lone:
                self.lone[node] = self.fresh[node] = self.lone[only]
        elif node not in self.branches:
            self.branches[node] = self.fresh[node] = (left, right)
        return node


    def written(self, node: bytes) -> dict[bytes, tuple[bytes, bytes]]:
        """New nodes that the tree below `node` holds: a lone leaf that moved up leaves the node it had further down."""
        out, open_nodes = {}, [node]
        while open_nodes:
            at = open_nodes.pop()
            if at in self.fresh and at not in out:
                out[at] = self.fresh[at]
                open_nodes += self.fresh[at] if at in self.branches else ()
        return out


def _written(spark: SparkSession, root: str, prefixes: list[str] | None = None) -> DataFrame:
    """Node rows as commits wrote them: one that two commits wrote is there twice."""
    fs, path = versions._path(spark, f"{root}/nodes")
    if not fs.exists(path):
        return spark.createDataFrame([], NODE)
    nodes = spark.read.schema(NODE).parquet(f"{root}/nodes")
    if prefixes is not None:
        nodes = nodes.where(F.col("head").isin(sorted({p[:HEAD_DIGITS] for p in prefixes})) & F.col("prefix").isin(prefixes))
    return nodes


def stored_nodes(spark: SparkSession, root: str, prefixes: list[str] | None = None) -> DataFrame:
    """Distinct stored nodes, of the given prefixes only if named: folders of other prefixes aren't listed for reading."""
    return _written(spark, root, prefixes).dropDuplicates(["prefix", "node_hash"])


def prefix_roots(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(prefix, root) of every subtree that isn't empty, as of a version."""
    try:
        return versions.read_table(spark, root, ROOTS, version)
    except KeyError:
        return spark.createDataFrame([], "prefix string, root string")


def tree_root(spark: SparkSession, root: str, version: int | None = None, digits: int = smt.PREFIX_DIGITS) -> DataFrame:
    """One row: the tree's root as of a version."""
    top = smt.combine(prefix_roots(spark, root, version), digits)
    return top.agg(F.coalesce(F.max("root"), F.lit(canon.EMPTY_SMT_ROOT)).alias("root"))


def commit(spark: SparkSession, root: str, changes: DataFrame, height: int, digits: int = smt.PREFIX_DIGITS) -> int:
    """Set (key, leaf) pairs, or take a key away where its leaf is null, and publish the tree as the next version.

    `changes` has one row per key.  What is read and written grows with the touched prefixes, not with the tree.
    """
    depth = 4 * digits
    asked = changes.select(F.substring("key", 1, digits).alias("prefix"), "key", "leaf")
    touched = [r.prefix for r in asked.select("prefix").distinct().collect()]  # at most 16^digits short names
    part = lambda df, kind: df.withColumn("kind", F.lit(kind))
    before = prefix_roots(spark, root).where(F.col("prefix").isin(touched))
    rows = part(_written(spark, root, touched).drop("head"), 0).unionByName(
        part(before.select("prefix", F.col("root").alias("node_hash")), 1), allowMissingColumns=True).unionByName(
        part(asked, 2), allowMissingColumns=True)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw = bytes.fromhex
        for pdf in smt._runs(batches, ["prefix"]):
            have, top, news = (pdf[pdf["kind"] == k] for k in (0, 1, 2))
            nodes = Nodes({}, {})
            for h, left, right, key, leaf in zip(have["node_hash"], have["left_hash"], have["right_hash"], have["key"], have["leaf"]):
                (nodes.branches if left else nodes.lone)[raw(h)] = (raw(left), raw(right)) if left else (raw(key), raw(leaf))
            start = raw(top["node_hash"].iloc[0]) if len(top) else canon.EMPTY_ROOTS[SMT_DEPTH - depth]
            listed = sorted((raw(k), raw(v) if v else None) for k, v in zip(news["key"], news["leaf"]))
            if any(a == b for (a, _), (b, _) in zip(listed, listed[1:])):
                raise ValueError("a key is changed twice")
            new, prefix = nodes.updated(start, depth, listed), pdf["prefix"].iloc[0]
            out = [(prefix, h.hex(), *((a.hex(), b.hex(), None, None) if h in nodes.branches else (None, None, a.hex(), b.hex()))) for h, (a, b) in nodes.written(new).items()]
            out.append((prefix, None if new == canon.EMPTY_ROOTS[SMT_DEPTH - depth] else new.hex(), None, None, "root", None))
            yield pd.DataFrame(out, columns=["prefix", "node_hash", "left_hash", "right_hash", "key", "leaf"])

    placed = rows.repartition(task_count(spark), "prefix").sortWithinPartitions("prefix")
    done = placed.mapInPandas(fold, "prefix string, node_hash string, left_hash string, right_hash string, key string, leaf string")
    staging = f"{root}/staged/{versions.uuid.uuid4().hex}"
    done.write.parquet(staging)
    done = spark.read.schema("prefix string, node_hash string, left_hash string, right_hash string, key string, leaf string").parquet(staging)
    is_root = F.coalesce(F.col("key") == "root", F.lit(False))
    done.where(~is_root).select(F.substring("prefix", 1, HEAD_DIGITS).alias("head"), "*").repartition("head").write.mode("append").partitionBy("head").parquet(f"{root}/nodes")
    roots = done.where(is_root & F.col("node_hash").isNotNull()).select("prefix", F.col("node_hash").alias("root"))
    return Staged(spark, root, {ROOTS: Delta(roots, [(done.where(is_root).select("prefix"), ["prefix"])])}).publish(height, kind="tree")


def _walked(spark: SparkSession, root: str, kept: list[int] | None, shown, schema: str) -> DataFrame:
    """`shown(prefix, stored, live)` of every prefix: its nodes by hash, as (left, right, key), and the hashes that the
    roots of the kept versions (default: the newest) reach.  A prefix holds all nodes below its roots, so it is walked
    where its nodes meet: one shuffle whatever the tree's depth."""
    kept = [versions.latest_version(spark, root)] if kept is None else kept
    raw = lambda c: F.unhex(c).alias(c)
    rows = _written(spark, root).select("prefix", raw("node_hash"), raw("left_hash"), raw("right_hash"), raw("key"), F.lit(False).alias("top"))
    for v in kept:
        rows = rows.unionByName(prefix_roots(spark, root, v).select("prefix", F.unhex("root").alias("node_hash"), F.lit(True).alias("top")),
                                allowMissingColumns=True)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in smt._runs(batches, ["prefix"]):
            nodes, tops = pdf[~pdf["top"]], pdf.loc[pdf["top"], "node_hash"]
            stored = dict(zip(nodes["node_hash"], zip(nodes["left_hash"], nodes["right_hash"], nodes["key"])))
            live, open_nodes = set(), list(tops)
            while open_nodes:
                at = open_nodes.pop()
                if at in stored and at not in live:
                    live.add(at)
                    open_nodes += [c for c in stored[at][:2] if c is not None]
            yield from shown(pdf["prefix"].iloc[0], stored, live)

    return rows.repartition(task_count(spark), "prefix").sortWithinPartitions("prefix").mapInPandas(walk, schema)


def live_nodes(spark: SparkSession, root: str, kept: list[int] | None = None) -> DataFrame:
    """Hashes of stored nodes that some kept version (default: the newest) still reaches."""
    def shown(prefix: str, stored: dict, live: set) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"node_hash": [h.hex() for h in live]}, dtype=object)

    return _walked(spark, root, kept, shown, "node_hash string").distinct()


def node_counts(spark: SparkSession, root: str, kept: list[int] | None = None) -> DataFrame:
    """One row: nodes stored under each prefix, those that kept versions (default: the newest) reach, and the keys of the
    lone leaves among these."""
    def shown(prefix: str, stored: dict, live: set) -> Iterator[pd.DataFrame]:
        keys = {stored[h][2] for h in live} - {None}
        yield pd.DataFrame([(len(stored), len(live), len(keys))], columns=["stored", "live", "leaves"])

    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return _walked(spark, root, kept, shown, "stored bigint, live bigint, leaves bigint").agg(total("stored"), total("live"), total("leaves"))


def orphan_stats(spark: SparkSession, root: str, kept: list[int] | None = None) -> DataFrame:
    """Stored nodes, those that kept versions reach, and the rest, which a sweep may remove."""
    total = _written(spark, root).agg(F.countDistinct("node_hash").alias("total_nodes"))
    reached = live_nodes(spark, root, kept).agg(F.count("*")).scalar()
    return total.withColumn("reachable_nodes", reached).withColumn("orphan_count", F.col("total_nodes") - F.col("reachable_nodes"))
