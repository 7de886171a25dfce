"""Skewed input against brute force: hot blocks, hot keys, copies, and small chunks."""

import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from blockloom.functions import canon
from blockloom.operators import aggregates as agg
from blockloom.operators import epochs, follow, integrity, merkle, scan, smt


def tree(leaves):
    """Independent fixed-tree root: recursive halves over a padded power of two."""
    width = 1
    while width < len(leaves):
        width *= 2
    nodes = [bytes.fromhex(x) for x in leaves] + [canon.EMPTY_ROOTS[0]] * (width - len(leaves))

    def root(lo, hi):
        return nodes[lo] if hi - lo == 1 else hashlib.sha256(b"\x01" + root(lo, (lo + hi) // 2) + root((lo + hi) // 2, hi)).digest()
    return root(0, width).hex()


@pytest.mark.parametrize("sizes", [{1: 5000, 2: 1, 3: 1024, 4: 1025, 5: 7}])
def test_hot_group_tree(spark, sizes):
    rows = [(b, hashlib.sha256(f"{b}/{i}".encode()).hexdigest()) for b, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["block_index", "leaf"]))
    placed = merkle.with_positions(df, ["block_index"], ["leaf"])
    got = {r.block_index: (r.root, r.leaf_count) for r in merkle.merkle_roots(placed, ["block_index"]).collect()}
    want = {b: (tree(sorted(x for k, x in rows if k == b)), n) for b, n in sizes.items()}
    assert got == want
    proofs = merkle.verify_inclusion(merkle.inclusion_proofs(placed.where("block_index in (2, 4)"), ["block_index"]))
    assert proofs.count() == 1026 and proofs.where("not verified").count() == 0


def test_hot_block_hash(spark):
    rows = [(7 if i % 3 else 8, i, f"a{i % 5}", "T", str(i)) for i in range(30_000)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["block_index", "action_index", "address", "tick", "amount"]))
    blocks = spark.createDataFrame([(7, "p", "p", "p"), (8, None, None, None)], "block_index bigint, ledger_hash string, actions_hash string, contract_hash string")
    got = {r.block_index: r.ledger_hash for r in integrity.block_hashes({"credits": df.repartition(7)}, blocks).collect()}
    for b, prior in ((7, ""), (8, ',"previous_hash":"p"')):
        body = ",".join(f'{{"action_index":{i},"address":"{a}","tick":"T","amount":"{v}"}}' for k, i, a, _, v in rows if k == b)
        doc = f'{{"credits":[{body}],"debits":[],"escrows":[],"block_index":{b}{prior},"hash_version":1}}'
        assert got[b] == hashlib.sha256(doc.encode()).hexdigest()


def test_copies_and_order_do_not_matter(spark):
    rows = [(1, "x")] * 500 + [(2, "y"), (3, None)]
    df = spark.createDataFrame(rows, "a int, b string")
    same = integrity.content_digests({"t": df.repartition(9, "a")}).first()
    assert same.digest == integrity.content_digests({"t": df.coalesce(1)}).first().digest and same.n_rows == 502
    fewer = spark.createDataFrame(rows[1:], "a int, b string")
    assert integrity.content_digests({"t": fewer}).first().digest != same.digest


def brute_smt(leaves):
    def node(items, depth):
        if not items:
            return canon.EMPTY_ROOTS[256 - depth]
        if depth == 256:
            return items[0][1]
        halves = ([], [])
        for k, v in items:
            halves[(k[depth // 8] >> (7 - depth % 8)) & 1].append((k, v))
        return hashlib.sha256(b"\x01" + node(halves[0], depth + 1) + node(halves[1], depth + 1)).digest()
    return node([(bytes.fromhex(k), bytes.fromhex(v)) for k, v in leaves], 0).hex()


def test_smt_against_brute_force(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    leaves = [(sha(f"k{i}"), sha(f"v{i}")) for i in range(150)]
    close = leaves[0][0]
    leaves.append((close[:-1] + ("0" if close[-1] != "0" else "1"), sha("near")))  # differs in the last bits only
    df = spark.createDataFrame(leaves, "key string, leaf string")
    want = brute_smt(leaves)
    for digits in (1, 2):
        assert smt.smt_root(df, digits).first().root == want
    asked = spark.createDataFrame([(k,) for k, _ in leaves[:20]] + [(sha(f"no{i}"),) for i in range(20)] + [(leaves[-1][0],)], "key string")
    proofs = smt.smt_proofs(df, asked, 1)
    checked = proofs.withColumn("ok", smt.verify_smt("root", "key", "leaf_value", "bitmap", "siblings")).collect()
    assert len(checked) == 41 and all(r.ok and r.root == want for r in checked)
    assert sum(r.leaf_value is None for r in checked) == 20
    forged = proofs.withColumn("leaf_value", F.lit(sha("forged")))
    assert not any(r.ok for r in forged.select(smt.verify_smt("root", "key", "leaf_value", "bitmap", "siblings").alias("ok")).collect())
    changed = leaves[:100] + [(leaves[120][0], sha("new"))]
    touched = spark.createDataFrame([(k,) for k, _ in leaves[100:]], "key string")
    threaded = smt.update_prefix_roots(smt.prefix_roots(df, 1), spark.createDataFrame(changed, "key string, leaf string"), touched, 1)
    assert smt.combine(threaded, 1).first().root == brute_smt(changed)


def test_epoch_tree(spark):
    log = spark.createDataFrame([(b, f"l{b}", None if b % 3 else f"a{b}", "c") for b in range(0, 34) if b != 15],
                                "block_index bigint, ledger_hash string, actions_hash string, contract_hash string")
    known = epochs.roots(log, 10)
    got = {r.epoch: (r.merkle_root, r.start_block, r.end_block, r.leaf_count) for r in known.collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for epoch in (1, 2, 3):
        heights = [b for b in range(epoch * 10 - 9, epoch * 10 + 1) if b != 15]
        layer = [sha(f"l{b}" + ("" if b % 3 else f"a{b}") + "c") for b in heights]
        while len(layer) > 1:
            layer = [sha(layer[i] + layer[min(i + 1, len(layer) - 1)]) for i in range(0, len(layer), 2)]
        assert got[epoch] == (layer[0], heights[0], heights[-1], len(heights))
    assert set(got) == {1, 2, 3}
    proofs = epochs.proofs(log, known, 10).collect()
    assert all(r.verified for r in proofs if r.epoch <= 3) and {r.error for r in proofs if r.epoch == 4} == {"epoch not yet committed"}
    shorter = epochs.proofs(log.where("block_index <> 4"), known, 10).where("epoch = 1").select("error").distinct().collect()
    assert [r.error for r in shorter] == ["epoch leaves incomplete"]


def test_gaps_across_buckets(spark):
    present = [0, 1, 2, 7, 19, 20, 21, 55]
    df = spark.createDataFrame([(p,) for p in present], "block_index bigint")
    for bucket in (1, 3, 10, 100):
        got = sorted((r.from_block, r.to_block) for r in follow.gap_ranges(df, bucket).collect())
        assert got == [(3, 6), (8, 18), (22, 54)]


def test_as_of_over_bucket_edges(spark):
    """A busy key, a null key, probes before, between and after its rows, and buckets that hold probes only."""
    import bisect

    rows = [(1, b, b if b % 3 else None) for b in range(0, 95, 5)] + [(None, 7, 70), (2, 50, 500)]
    journal = spark.createDataFrame([(i, k, b, None if v is None else str(v)) for i, (k, b, v) in enumerate(rows)], "id int, k int, block_index int, v string")
    probes = spark.createDataFrame([(k, b) for k in (1, 2, 3, None) for b in range(-3, 130, 4)], "k int, block_index int")

    def want(k, b):
        mine = sorted((x, v) for kk, x, v in rows if kk == k)
        at = bisect.bisect_right([x for x, _ in mine], b) - 1
        return None if at < 0 or mine[at][1] is None else str(mine[at][1])

    for bucket in (1, 10, 1_000):
        got = agg.as_of_many(journal, probes, ["k"], "v", bucket=bucket).collect()
        assert len(got) == probes.count() and all(r.v == want(r.k, r.block_index) for r in got)


def test_log_pages_over_bucket_edges(spark):
    log = spark.range(0, 57).where("id % 7 <> 3").select((F.col("id") + 3).alias("block_index"), F.lit("x").alias("h"))
    heights = sorted((r.block_index for r in log.collect()), reverse=True)
    for page in range(0, 8):
        got = scan.log_page(log, page, 9, ["block_index"], bucket=10).collect()
        assert [r.block_index for r in got] == heights[9 * page: 9 * page + 9] and all(r.total == len(heights) for r in got)
