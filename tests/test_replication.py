"""Apply, snapshot, rollback and versions on small ledgers."""

import pytest
from pyspark.sql import functions as F

from blockloom.operators import aggregates as agg
from blockloom.operators import apply as ap
from blockloom.operators import changes, integrity, rollback, scan
from blockloom.sources import versions
from blockloom.streaming import pipeline
from tests.ledger import ROW, as_sets, build, payload


def test_rollback_undoes_apply(spark):
    before, news = build(spark, range(1, 12), debit="250"), build(spark, range(12, 16), debit="1000")
    before["balances"] = agg.balances(before["credits"], before["debits"])
    data = {t: news[t] for t in ("blocks", "transactions", "actions", "credits", "debits")}
    after = ap.apply_changes(before, data, {})
    assert as_sets({"b": after["balances"]}) == as_sets({"b": agg.balances(after["credits"], after["debits"])})
    assert after["blocks"].count() == 15
    back = rollback.rollback_indexer(after, 12)
    assert as_sets({t: back[t] for t in before}) == as_sets(before)


def test_reorg_replay_equals_source(spark):
    source = build(spark, range(1, 18))
    replacement = build(spark, range(18, 22), amount="5555")
    replica = rollback.rollback_indexer(build(spark, range(1, 21)), 18)
    data = {t: replacement[t] for t in ("blocks", "transactions", "actions", "credits")}
    replica = ap.apply_changes(replica, data, {})
    want = {t: source[t].unionByName(replacement[t]) for t in data}
    assert as_sets({t: replica[t] for t in data}) == as_sets(want)
    assert integrity.compare_content(integrity.content_digests({t: replica[t] for t in data}),
                                     integrity.content_digests(want)).where("verdict <> 'match'").count() == 0


def test_incremental_after_partial_equals_full(spark):
    full = build(spark, range(1, 21), debit="3")
    replica = build(spark, range(1, 11), debit="3")
    statuses = spark.createDataFrame([(1, "valid")], "id bigint, status string")
    data, updated = ap.incremental_snapshot(full, 11, 20, None, "TOKEN", statuses, skip_lookups=True)
    assert set(data) == {"blocks", "transactions", "actions", "credits", "debits", "escrows"} and not any(df.count() for df in updated.values())
    assert as_sets(ap.apply_changes(replica, data, updated)) == as_sets(full)


def test_supply_cases(spark):
    tokens = spark.createDataFrame([(1, "9999", 8), (2, "1", 0), (3, "9999", 8), (4, "0", 8), (5, "123", 8), (6, "0", 0)], "tick_id bigint, supply string, decimals int")
    credits = spark.createDataFrame([(1, 1, 1, "1000"), (2, 1, 1, "500"), (3, 1, 2, "700"), (4, 1, 4, "10.5"), (5, 1, 5, "100"), (6, 1, 6, "9" * 38)], ROW)
    debits = spark.createDataFrame([(7, 1, 1, "200"), (8, 1, 5, "100")], ROW)
    escrows = spark.createDataFrame([(9, 1, 1, "50")], ROW)
    got = {r.tick_id: r.supply for r in agg.token_supplies(tokens, credits, debits, escrows).collect()}
    assert got == {1: "1350", 2: "700", 3: "0", 4: "10.5", 5: "0", 6: "9" * 38}


def test_scoped_balances_equal_full(spark):
    n38, big = "9" * 38, "12345678901234567890"
    old_c = [(1, 1, "1000"), (2, 1, "250"), (2, 2, n38), (3, 2, "7"), (4, 3, big), (5, 3, "500")]
    old_d = [(1, 1, "400"), (2, 1, "50"), (5, 3, "500")]
    cols = "address_id bigint, tick_id bigint, amount string"
    frame = lambda rows: spark.createDataFrame(rows, cols)
    existing = agg.balances(frame(old_c), frame(old_d))
    credits, debits = frame(old_c + [(3, 2, "13")]), frame(old_d + [(2, 1, "200")])
    touched = frame([(3, 2, ""), (2, 1, "")])
    scoped = {tuple(r) for r in agg.balances_scoped(existing, credits, debits, touched).collect()}
    assert scoped == {(1, 1, "600"), (2, 2, n38), (3, 2, "20"), (4, 3, big)}
    assert scoped == {tuple(r) for r in agg.balances(credits, debits).collect()}


def test_mutation_capture_edges(spark):
    stakes = spark.createDataFrame([(1, 106), (2, 105), (3, None)], "action_index bigint, deactivation_block bigint")
    debits = spark.createDataFrame([(1, "stakes", 100), (3, "stakes", 100), (2, "unstakes", 100)], "stake_action_index bigint, target_table string, block_index bigint")
    got = changes.updated_rows({"stakes": stakes, "capability_slash_debits": debits}, 100, 100, 6)["stakes"]
    assert sorted(r.action_index for r in got.collect()) == [1, 3]
    polls = spark.createDataFrame([(1, 60, 70, 5), (2, 60, 70, None)], "action_index bigint, resolved_block bigint, callback_due_block bigint, callback_execute_action_index bigint")
    assert [r.action_index for r in changes.updated_rows({"polls": polls}, 70, 70, None)["polls"].collect()] == [1]


def test_null_rules_of_sweeps(spark):
    rows = spark.createDataFrame([(1,), (9,), (None,)], "address_id bigint")
    lookup = spark.createDataFrame([(1,)], "id bigint")
    kept = lambda ids: sorted((r.address_id for r in rollback.keep_referenced(rows, "address_id", ids).collect()), key=str)
    assert kept(lookup) == [1, None]
    assert kept(lookup.limit(0)) == []
    assert kept(lookup.union(spark.createDataFrame([(None,)], "id bigint"))) == [1, 9, None]


def test_preimages_and_feeds(spark):
    stakes = spark.createDataFrame([(1, "5"), (2, "8")], "action_index bigint, amount string")
    log = spark.createDataFrame([(1, "stakes", "10", 50, 2), (1, "stakes", "9", 50, 1), (1, "stakes", "99", 40, 0), (2, "unstakes", "7", 60, 1)],
                                "stake_action_index bigint, target_table string, prev_amount string, block_index bigint, slash_action_index bigint")
    out = {r.action_index: r.amount for r in rollback.restore_preimages(stakes, "stakes", {"capability_slash_debits": log}, 50).collect()}
    assert out == {1: "9", 2: "8"}
    statuses = spark.createDataFrame([(4, "open"), (5, "closed")], "id bigint, status string")
    feeds = spark.createDataFrame([(1, 12, 10, 60), (2, 12, 55, 60), (3, 12, None, 60), (4, 5, 55, None), (5, 5, 10, 20)],
                                  "action_index bigint, feed_status_id bigint, closed_block bigint, terminal_block bigint")
    got = {r[0]: tuple(r)[1:] for r in rollback.reset_bet_feeds(feeds, statuses, 50).collect()}
    assert got == {1: (5, 10, None), 2: (4, None, None), 3: (4, None, None), 4: (4, None, None), 5: (5, 10, 20)}
    assert {tuple(r) for r in rollback.reset_bet_feeds(feeds, statuses.limit(0), 50).collect()} == {tuple(r) for r in feeds.collect()}


def test_versions_and_pruning(spark, tmp_path):
    root = str(tmp_path)
    assert versions.latest_version(spark, root) is None
    tables = build(spark, range(1, 31))
    assert versions.write_version(spark, root, tables, 30, bucket_width=10) == 0
    more = {"blocks": tables["blocks"].unionByName(build(spark, range(31, 33))["blocks"])}
    assert versions.write_version(spark, root, more, 32, bucket_width=10, touched={"blocks": [3]}) == 1
    assert versions.read_table(spark, root, "blocks").count() == 32
    assert versions.read_table(spark, root, "blocks", version=0).count() == 30
    window = versions.read_table(spark, root, "blocks", window=(15, 18), bucket_width=10)
    assert sorted(r.block_index for r in window.collect()) == [15, 16, 17, 18] and len(window.inputFiles()) <= 8
    assert versions.read_table(spark, root, "credits").count() == 30
    assert versions.version_stats(spark, root).count() == 2


def test_pipeline_applies_verifies_and_halts(spark, tmp_path):
    root, source = str(tmp_path / "db"), tmp_path / "in"
    zero = {"ledger": "l0", "actions": "a0", "contracts": "c0"}
    full = build(spark, range(1, 9))
    hashes = integrity.commit_block_hashes(full, full["blocks"], zero)
    hashes = spark.createDataFrame(hashes.collect(), hashes.schema)
    full["blocks"] = full["blocks"].join(hashes, "block_index")
    base = build(spark, range(0, 0))
    seed = spark.createDataFrame([(0, 0, "l0", "a0", "c0")], "block_index bigint, block_time bigint, ledger_hash string, actions_hash string, contract_hash string")
    base["blocks"] = seed.select(full["blocks"].columns)
    base["balances"] = agg.balances(base["credits"], base["debits"])
    versions.write_version(spark, root, base, 0, bucket_width=4)
    rows = payload({t: full[t] for t in ("blocks", "transactions", "actions", "credits")}, range(1, 9))
    rows.coalesce(1).write.parquet(str(tmp_path / "all"))
    rows = spark.read.parquet(str(tmp_path / "all"))
    rows.where("block_index <= 5").coalesce(1).write.parquet(str(source / "a"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = pipeline.run_pipeline(stream, root, str(tmp_path / "cp"), bucket_width=4)
    try:
        query.processAllAvailable()
        got = pipeline.load_tables(spark, root)
        assert got["blocks"].count() == 6 and got["credits"].count() == 5
        assert as_sets({"b": got["balances"]}) == as_sets({"b": agg.balances(got["credits"], got["debits"])})
        assert pipeline.apply_batch(spark, root, rows.where("block_index <= 5")) is None  # replay is a no-op
    finally:
        query.stop()
    dropped = rows.where("block_index > 5 and not (block_index = 7 and table = 'credits')")
    with pytest.raises(pipeline.Halted, match="ledger_hash of block 7"):
        pipeline.apply_batch(spark, root, dropped, bucket_width=4)
    assert pipeline.load_tables(spark, root)["blocks"].count() == 6
    with pytest.raises(pipeline.Halted):
        pipeline.apply_batch(spark, root, rows.where("block_index > 5"), bucket_width=4)
    pipeline.record_verdict(spark, root, "clear", None, "operator")
    assert pipeline.apply_batch(spark, root, rows.where("block_index > 5"), bucket_width=4) is not None
    assert pipeline.load_tables(spark, root)["blocks"].count() == 9


def test_schema_helpers(spark):
    a = spark.createDataFrame([("t", "x", "int"), ("t", "y", "int")], "table string, column string, type string")
    b = spark.createDataFrame([("t", "x", "bigint"), ("t", "z", "int")], "table string, column string, type string")
    got = {r.column: r.change for r in scan.schema_diff(a, b).collect()}
    assert got == {"x": "type differs", "y": "add", "z": "replica only"}
    with pytest.raises(Exception, match="schema version"):
        scan.schema_gate(spark.createDataFrame([(6,)], "schema_version int"), 7).collect()


def test_binary_exchange(spark):
    from blockloom.functions.canon import decode_binary_json, encode_binary_json
    df = spark.createDataFrame([(1, bytearray(b"\x00\xff")), (2, None)], "id int, b binary")
    wire = encode_binary_json(df)
    assert wire.where("row_json like '%__xbin__%'").count() == 1
    assert {(r.id, bytes(r.b) if r.b is not None else None) for r in decode_binary_json(wire, df.schema).collect()} == {(1, b"\x00\xff"), (2, None)}


def test_fork_and_page_edges(spark):
    ids = spark.range(1, 11).toDF("id")
    page = scan.id_page(ids, after=3, limit=4).collect()
    assert [r.id for r in page] == [4, 5, 6, 7] and page[0].max_id == 7 and page[0].has_more
    assert not scan.id_page(ids, after=8, limit=4).first().has_more
    assert scan.first_action(spark.createDataFrame([(5, 1)], "action_index bigint, block_index bigint"), 2).first()[0] is None
    base = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 1, "a")], ROW)
    extra = spark.createDataFrame([(1, 1, 1, "b"), (2, 1, 1, "c"), (2, 1, 1, "c")], ROW)
    assert scan.merge_side_channel(base, extra, changes.CREDIT_IDENTITY).count() == 3
    assert base.select(F.count("*")).first()[0] == 2
