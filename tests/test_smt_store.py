"""Stored tree nodes against trees folded from all leaves: inserts, changes, deletes, versions, pruning, orphans."""

import random
import re

import pytest

from blockloom.fixed_values import SMT_DEPTH
from blockloom.functions import canon
from blockloom.operators import smt, smt_store
from blockloom.sources import versions

SCHEMA = "key string, leaf string"


def sha(n):
    import hashlib

    return hashlib.sha256(str(n).encode()).hexdigest()


def root_of(leaves, depth=0):
    """The tree's root from all leaves at once."""
    sub = smt._Subtree(list(leaves), list(leaves.values()))
    return sub.node(0, len(sub.keys), depth)


def test_updates_in_memory_equal_a_rebuild():
    rng = random.Random(6)
    close = [f"{'ab' * 31}{i:02x}" for i in range(20)]  # keys that part only at the last byte
    pool = close + [sha(i) for i in range(60)]
    nodes, held, top = smt_store.Nodes({}, {}), {}, canon.EMPTY_ROOTS[SMT_DEPTH]
    for _ in range(60):
        picked = rng.sample(pool, rng.randint(1, 9))
        changes = {k: rng.choice([None, sha(rng.random())]) for k in picked}
        held = {k: v for k, v in (held | changes).items() if v is not None}
        top = nodes.updated(top, 0, sorted((bytes.fromhex(k), bytes.fromhex(v) if v else None) for k, v in changes.items()))
        assert top == root_of(held)
    top = nodes.updated(top, 0, sorted((bytes.fromhex(k), None) for k in held))
    assert top == canon.EMPTY_ROOTS[SMT_DEPTH]


def test_commits_and_versions(spark, tmp_path):
    root, digits = str(tmp_path / "tree"), 2
    first = {sha(i): sha(-i) for i in range(300)}
    second = {sha(0): None, sha(1): sha("new"), sha(1000): sha("more")}
    frame = lambda d: spark.createDataFrame(list(d.items()), SCHEMA)
    assert smt_store.commit(spark, root, frame(first), 1, digits) == 0
    assert smt_store.commit(spark, root, frame(second), 2, digits) == 1
    held = {k: v for k, v in (first | second).items() if v is not None}
    tops = [smt_store.tree_root(spark, root, v, digits).first().root for v in (0, 1)]
    assert tops == [root_of(first).hex(), root_of(held).hex()]
    stats = smt_store.orphan_stats(spark, root).first()
    kept = smt_store.orphan_stats(spark, root, [0, 1]).first()
    assert stats.orphan_count > 0 and kept.orphan_count == 0 and kept.total_nodes == stats.total_nodes < 4 * len(first)
    lone = smt_store.stored_nodes(spark, root).where("key is not null").join(smt_store.live_nodes(spark, root), "node_hash", "left_semi")
    assert lone.select("key").distinct().count() == len(held)
    # back to the first tree: the nodes are there already, and the root is the old one
    smt_store.commit(spark, root, frame({k: first.get(k) for k in second}), 3, digits)
    assert smt_store.tree_root(spark, root, None, digits).first().root == tops[0]
    smt_store.commit(spark, root, frame({k: None for k in first}), 4, digits)
    assert smt_store.prefix_roots(spark, root).count() == 0
    assert smt_store.tree_root(spark, root, None, digits).first().root == canon.EMPTY_SMT_ROOT
    with pytest.raises(Exception, match="changed twice"):
        smt_store.commit(spark, root, spark.createDataFrame([(sha(5), sha(1)), (sha(5), sha(2))], SCHEMA), 5, digits)
    assert versions.latest_version(spark, root) == 3


def test_only_touched_prefixes_are_read(spark, tmp_path):
    root = str(tmp_path / "tree")
    smt_store.commit(spark, root, spark.createDataFrame([(sha(i), sha(-i)) for i in range(200)], SCHEMA), 1)
    prefix = sha(7)[:3]
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        near = smt_store.stored_nodes(spark, root, [prefix])
        assert {r.prefix for r in near.collect()} == {prefix}
        plan = near._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(rf"PartitionFilters: \[[^\]]*head#\d+ = {prefix[:2]}", plan) and re.search(rf"PushedFilters: \[[^\]]*prefix,{prefix}", plan)


def test_live_nodes_are_walked_under_their_prefix(spark, tmp_path, monkeypatch):
    """No lookup per level of the tree: a prefix's nodes meet once, and nothing is kept in between."""
    def refused(df):
        raise AssertionError("a level was kept")

    monkeypatch.setattr(smt, "materialise", refused)
    root, digits = str(tmp_path / "tree"), 2
    first = {sha(i): sha(-i) for i in range(200)}
    second = {sha(0): None, sha(1): sha("new"), sha(300): sha("more")}
    for height, leaves in enumerate((first, second)):
        smt_store.commit(spark, root, spark.createDataFrame(list(leaves.items()), SCHEMA), height, digits)
    live = {r.node_hash for r in smt_store.live_nodes(spark, root).collect()}
    held = {r.node_hash: r for r in smt_store.stored_nodes(spark, root).collect()}
    want, asked = set(), [r.root for r in smt_store.prefix_roots(spark, root).collect()]
    while asked:
        at = asked.pop()
        if at in held and at not in want:
            want.add(at)
            asked += [held[at].left_hash, held[at].right_hash]
    assert live == want and len(want) < len(held)
    counts = smt_store.node_counts(spark, root).first()
    assert (counts.stored, counts.live, counts.leaves) == (len(held), len(want), 200)
    assert smt_store.node_counts(spark, root, [0, 1]).first().live == len(held)
    assert smt_store.node_counts(spark, str(tmp_path / "none"), []).first() == (0, 0, 0)
