"""Canonical texts, gates, thresholds and role names."""

import pytest
from pyspark.sql import functions as F

from blockloom.functions import canon, gates
from blockloom.operators import apply as ap
from blockloom.operators import scan, smt, stake


def test_checkpoint_text(spark):
    row = spark.createDataFrame([("BTC", "regtest", 7, "bh", "l", "a", "c", 3, 5, "AB", 1, "CD", 1), ("BTC", "regtest", 7, "bh", "l", "a", "c", 3, 5, None, 1, "CD", 1)],
                                "chain string, network string, block_index bigint, block_hash string, ledger_hash string, actions_hash string, contract_hash string, "
                                "checkpoint_seq bigint, snapshot_block bigint, state_root string, state_root_version int, block_merkle_root string, block_merkle_version int")
    base = "XCHECKPOINT|BTC|regtest|7|bh|l|a|c|3|5"
    plain = [r[0] for r in row.select(canon.checkpoint_text(F.lit(True), F.lit(False))).collect()]
    assert plain == [base + "|ab|1|cd|1", base]
    assert row.select(canon.checkpoint_text(F.lit(False), F.lit(True))).first()[0] == "EQUIV|XCHECKPOINT|BTC|regtest|7|3|0||" + base


def test_gates(spark):
    rows = spark.createDataFrame([(958499,), (958500,)], "b bigint")
    active = rows.select("b", gates.is_active("state_commitment", F.col("b"), "BTC", "mainnet").alias("on"),
                         gates.is_boundary("state_commitment", F.col("b"), "BTC", "mainnet").alias("edge"),
                         gates.is_active("state_commitment", F.col("b"), "BTC", "nowhere").alias("off")).collect()
    assert [(r.on, r.edge, r.off) for r in active] == [(False, False, False), (True, True, False)]
    heights = spark.createDataFrame([("12",), ("-1",), ("1e3",), (None,), ("012",)], "t string").select(canon.strict_height(F.col("t"))).collect()
    assert [r[0] for r in heights] == [12, None, None, None, 12]
    version = rows.select(gates.state_root_version(F.lit(10000), "BTC", "regtest"), gates.state_root_version(F.lit(9999), "BTC", "regtest")).first()
    assert tuple(version) == (2, 1)
    with pytest.raises(ValueError):
        gates.gated_sub_roots({"typo_root": F.lit("x")}, F.lit(1), "BTC", "regtest")


def test_thresholds_and_fields(spark):
    n = spark.range(0, 12).select("id", stake.count_threshold(F.col("id")).alias("q")).collect()
    want = lambda k: 1 if k <= 1 else max(2 * ((k - 1) // 3) + 1, -(-(k + 1) // 2))
    assert [r.q for r in n] == [want(r.id) for r in n]
    with pytest.raises(Exception, match="NUL"):
        spark.range(1).select(canon.join_fields(F.lit("a\x00b"))).collect()
    roles = spark.createDataFrame([("XXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXX",), ("someone",), (None,)], "a string").select(scan.canonical_role(F.col("a"))).collect()
    assert [r[0] for r in roles] == ["REWARD", "someone", None]
    assert [r[0] for r in spark.range(4).select(canon.backoff_ms(1000, 5000, F.col("id"))).collect()] == [1000, 2000, 4000, 5000]
    assert smt.prefix_digits(1000) == 3 and smt.prefix_digits(10**11) == 6
    assert ap.reconcile_due(False, 10, 5, 0, 1000) and not ap.reconcile_due(False, 11, 5, 0, 1000) and ap.reconcile_due(False, 11, 5, 1000, 1000)


def test_quorum_fails_closed(spark):
    schema = "g int, pubkey string, source string, weight string, truncated boolean"
    rows = [(1, "A", "s1", "3", False), (1, "B", "s2", "1", False), (2, "A", "s1", "3", False), (2, "B", " ", "1", False),
            (3, "A", "s1", "x", False), (4, "A", "s1", "3", True), (5, "A", "s1", "2", False), (5, "B", "s2", "1", False), (6, "A", "s1", "-3", False), (7, "A", "s1", "0", False)]
    signers = spark.createDataFrame([(g, "a") for g in range(1, 8)], "g int, pubkey string")
    got = {r.g: r.meets_quorum for r in stake.stake_quorum(spark.createDataFrame(rows, schema), signers, ["g"]).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False}
