"""Commitments per height: threaded roots against whole trees, and a changed middle block that stops a batch."""

import pytest
from pyspark.sql import functions as F

from blockloom.functions import canon
from blockloom.operators import aggregates as agg
from blockloom.operators import integrity, merkle, smt, verify
from blockloom.sources import versions
from blockloom.streaming import pipeline
from tests.ledger import ROW, build, payload

CHAIN, NETWORK, COMMITS = "BTC", "regtest", {"chain": "BTC", "network": "regtest", "digits": 1}


def ledger(spark):
    full = build(spark, range(0, 8), debit="4")
    # block 6 takes away all that address 2 has, block 7 pays it again
    full["debits"] = full["debits"].unionByName(spark.createDataFrame([(600, 2, 1, "996")], ROW))
    full["credits"] = full["credits"].where("action_index <> 600 and action_index <> 700").unionByName(
        spark.createDataFrame([(600, 1, 1, "7"), (700, 2, 1, "50.5")], ROW))
    return full


def whole_root(full, height):
    """The balances root from every ledger row up to a height."""
    below = full["actions"].where(F.col("block_index") <= height).select("action_index")
    cut = {t: full[t].join(below, "action_index", "left_semi") for t in ("credits", "debits")}
    leaves = smt.balance_leaves(cut["credits"], cut["debits"], full["index_addresses"], full["index_tickers"], CHAIN, NETWORK).collect()
    sub = smt._Subtree([r.key for r in leaves], [r.leaf for r in leaves])
    return sub.node(0, len(leaves), 0).hex()


def below(full, height):
    """The replica's tables before a batch from `height` on."""
    out = {t: df.where(F.col("block_index") < height) if t in ("blocks", "transactions", "actions") else df.where(F.col("action_index") < 100 * height) if t in ("credits", "debits") else df
           for t, df in full.items()}
    out["balances"] = agg.balances(out["credits"], out["debits"])
    return out


def test_threaded_roots_and_a_changed_block(spark, tmp_path):
    full = ledger(spark)
    base = below(full, 4)
    got = {r.block_index: r.balances_root for r in verify.balances_roots(base["balances"], full, 4, 7, CHAIN, NETWORK, 1).collect()}
    assert got == {h: whole_root(full, h) for h in range(4, 8)}
    content = {r.block_index: r.block_merkle_root for r in merkle.block_merkle_roots(full, full["blocks"]).collect()}
    state = integrity.state_hashes(full, full["blocks"].where("block_index = 7"), None, CHAIN, NETWORK).first().state_hash
    heads = spark.createDataFrame([(h, got.get(h), content[h], state if h == 7 else None) for h in range(8)],
                                  "block_index bigint, balances_root string, block_merkle_root string, state_hash string")
    full["blocks"] = full["blocks"].join(heads, "block_index")
    base = below(full, 4)
    root = str(tmp_path / "db")
    versions.write_version(spark, root, base, 3)
    changed = dict(full)
    changed["credits"] = full["credits"].withColumn("amount", F.when(F.col("action_index") == 500, "1001").otherwise(F.col("amount")))
    names = ("blocks", "transactions", "actions", "credits", "debits")
    batch = lambda t: payload({n: t[n] for n in names}, range(4, 8))
    bad = verify.mismatches(base, {**changed, "balances": base["balances"]}, 4, 7, **COMMITS)
    assert sorted((r.block_index, r.field) for r in bad.collect()) == [(5, "balances_root"), (5, "block_merkle_root"), (6, "balances_root"), (7, "balances_root")]
    with pytest.raises(pipeline.Halted, match="balances_root of block 5"):
        pipeline.apply_batch(spark, root, batch(changed), commitments=COMMITS)
    assert versions.latest_version(spark, root) == 0
    pipeline.record_verdict(spark, root, "clear", None, "operator")
    assert pipeline.apply_batch(spark, root, batch(full), commitments=COMMITS) == 1


def test_empty_tree_before_and_after(spark):
    leaf = canon.EMPTY_ROOTS[3].hex()
    changes = spark.createDataFrame([(5, "ab" * 32, leaf), (6, "ab" * 32, None)], "block_index bigint, key string, leaf string")
    none = changes.select("key", "leaf").limit(0)
    heights = spark.createDataFrame([(4,), (5,), (6,)], "block_index bigint")
    got = {r.block_index: r.root for r in verify.tree_roots_by_height(none, changes, heights, 1).collect()}
    assert got[4] == got[6] == canon.EMPTY_SMT_ROOT and got[5] == smt.smt_root(changes.where("block_index = 5").select("key", "leaf"), 1).first().root
