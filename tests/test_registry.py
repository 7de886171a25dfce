"""The stock registry covers every table once and its derived lists agree with each other."""

from collections import Counter

from blockloom import registry as reg


def test_counts():
    assert len({e.table for e in reg.INDEXER}) == len(reg.INDEXER) == 128
    assert Counter(e.replication for e in reg.INDEXER) == {
        "stream:action": 86, "stream:block": 11, "stream:index": 10, "stream:special": 1, "snapshot": 8, "hub-mirror": 7, "local": 4, "follower-derived": 1}
    assert Counter(e.rollback for e in reg.INDEXER) == {
        "action": 86, "block": 12, "index": 2, "lookup": 8, "recomputed": 3, "special": 4, "exempt": 11, None: 2}
    assert Counter(e.replica_rollback for e in reg.INDEXER) == {"mirror": 99, "special": 11, "lookup": 8, "exempt": 5, "local": 4, "recomputed": 1}


def test_every_streamed_table_rolls_back_and_is_digested_or_excluded():
    plan, mutable = reg.parity_plan(), set(reg.tables_with_hash_class("state_hash"))
    for e in reg.INDEXER:
        if e.replication.startswith("stream:"):
            assert e.rollback or e.owner == "sync"
            assert e.table in plan or e.table in mutable
    assert plan["contract_emissions"] == "emission" and plan["index_addresses"] == "block" and plan["index_statuses"] == "id"
    assert "dispensers" not in reg.parity_plan("decoder") and reg.parity_plan("decoder")["transaction_outputs"] == "tx"
    assert reg.write_mode("index_actions") == "ignore" and reg.write_mode("markets") == "upsert"
    assert reg.write_mode("blocks") == "replace" and reg.write_mode("credits") == "insert"


def test_snapshot_order(spark):
    names = ["zeta", "balances", "actions", "index_actions", "alpha", "icons", "sync_halt", "state_tree_roots", "pubkeys"]
    rows = reg.snapshot_order(spark.createDataFrame([(n,) for n in names], "table string")).orderBy("export_rank", "table").collect()
    assert [r.table for r in rows] == ["index_actions", "actions", "alpha", "zeta", "balances", "pubkeys"]
    report = {(r.replication, r.rollback): r.n_tables for r in reg.topology_report(reg.registry_frame(spark)).collect()}
    assert report["stream:index", "lookup"] == 8
