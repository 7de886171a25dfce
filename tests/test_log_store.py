"""The version log: writes as large as the batch, merge on read, branches, crashes, and streams through forks and gaps."""

import pytest
from pyspark.sql import functions as F

from blockloom.operators import aggregates as agg
from blockloom.operators import apply
from blockloom.sources import versions
from blockloom.sources.versions import Delta, Staged
from blockloom.streaming import pipeline
from tests.ledger import as_sets, build, payload


def chained(spark, heights, fork=None, amount="1000"):
    """A ledger whose blocks carry a hash; from `fork` on, those of another branch."""
    tables = build(spark, heights, amount)
    side = F.when(F.col("block_index") >= (fork or 10**9), "b").otherwise("a")
    tables["blocks"] = tables["blocks"].withColumn("ledger_hash", F.concat(side, "block_index"))
    return tables


def merged(spark, fork, tip):
    """Blocks below the fork from one branch, the rest from the other."""
    below, above = chained(spark, range(1, fork)), chained(spark, range(fork, tip + 1), fork, "77")
    return {t: below[t].unionByName(above[t]) for t in ("blocks", "transactions", "actions", "credits")}


def seeded(spark, root):
    base = chained(spark, range(0, 1))
    base["balances"] = agg.balances(base["credits"], base["debits"])
    versions.write_version(spark, root, base, 0)


def write_payload(tables, heights, path):
    payload({t: tables[t] for t in ("blocks", "transactions", "actions", "credits")}, heights).coalesce(1).write.parquet(path)


def check_same(spark, root, want):
    got = pipeline.load_tables(spark, root)
    below = {t: df.where(F.col("block_index") >= 1) if "block_index" in df.columns else df.where("action_index >= 100") for t, df in got.items() if t in want}
    assert as_sets(below) == as_sets(want)
    assert as_sets({"b": got["balances"]}) == as_sets({"b": agg.balances(got["credits"], got["debits"])})


def test_writes_grow_with_the_batch_only(spark, tmp_path):
    sizes = []
    for n in (50, 5_000):
        root = str(tmp_path / str(n))
        base = {"blocks": spark.range(n).select(F.col("id").alias("block_index"), F.sha2(F.col("id").cast("string"), 256).alias("ledger_hash")),
                "bets": spark.range(n).select(F.col("id").alias("action_index"), F.sha2(F.col("id").cast("string"), 256).alias("settled_by"))}
        versions.write_version(spark, root, base, n - 1)
        news = {"blocks": Delta(spark.createDataFrame([(n, "h")], "block_index bigint, ledger_hash string")),
                "bets": Delta(spark.createDataFrame([(3, "x")], "action_index bigint, settled_by string"), [(spark.createDataFrame([(3,)], "action_index bigint"), ["action_index"])])}
        Staged(spark, root, news).publish(n)
        assert versions.read_table(spark, root, "blocks").count() == n + 1
        bets = versions.read_table(spark, root, "bets")
        assert bets.count() == n and [r.settled_by for r in bets.where("action_index = 3").collect()] == ["x"]
        sizes.append({r.version: r.n_bytes for r in versions.version_stats(spark, root).collect()})
    assert sizes[0][1] == sizes[1][1] and sizes[1][0] > 20 * sizes[1][1]


def test_full_manifests_compaction_and_old_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FULL_EVERY", 3)
    root = str(tmp_path / "s")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    keys = lambda *k: (spark.createDataFrame([(x,) for x in k], "k int"), ["k"])
    versions.write_version(spark, root, {"t": frame((1, "a"), (None, "n"))}, 0)
    want = {1: "a", None: "n"}
    for i in range(2, 9):
        Staged(spark, root, {"t": Delta(frame((i, "x"), (None, f"n{i}")), [keys(i - 1, None)])}).publish(i)
        want = {k: v for k, v in want.items() if k not in (i - 1, None)} | {i: "x", None: f"n{i}"}
        assert {r.k: r.v for r in versions.read_table(spark, root, "t").collect()} == want
    assert {r.k: r.v for r in versions.read_table(spark, root, "t", version=2).collect()} == {3: "x", None: "n3"}
    assert versions.compact(spark, root, most_parts=50) is None
    assert versions.compact(spark, root, most_parts=5) == 8
    assert {r.k: r.v for r in versions.read_table(spark, root, "t").collect()} == want
    assert [(r.n_parts, r.n_tombstones) for r in versions.table_stats(spark, root).collect()] == [(1, 0)]


def test_two_writers_and_a_torn_manifest(spark, tmp_path):
    root = str(tmp_path / "s")
    versions.write_version(spark, root, {"t": spark.createDataFrame([(1,)], "k int")}, 0)
    one, two = (Staged(spark, root, {"t": Delta(spark.createDataFrame([(k,)], "k int"))}) for k in (2, 3))
    assert one.publish(1) == 1
    with pytest.raises(versions.ConcurrentWrite):
        two.publish(1)
    torn = tmp_path / "s" / "_versions" / "0" / f"{2:020d}.json"
    torn.write_text('{"version": 2, "par')
    assert versions.latest_version(spark, root) == 1
    assert Staged(spark, root, {"t": Delta(spark.createDataFrame([(4,)], "k int"))}).publish(2) == 3
    assert sorted(r.k for r in versions.read_table(spark, root, "t").collect()) == [1, 2, 4]


def test_first_of_a_key_lands(spark):
    old = spark.createDataFrame([(5, "old")], "id int, v string")
    new = spark.createDataFrame([(1, "b", 26), (1, "a", 27), (5, "x", 26)], "id int, v string, __height int")
    assert sorted(map(tuple, apply.insert_ignore(old, new, ["id"]).collect())) == [(1, "b"), (5, "old")]


def test_reward_earned_again_survives(spark):
    schema = "source_id int, signing_pubkey_id int, reward_type string, round_reference string, block_index bigint, amount string"
    old = spark.createDataFrame([(1, 1, "a", None, 4, "5"), (2, 1, "a", "r", 4, "6"), (3, 1, "a", "r", 4, "7")], schema)
    new = spark.createDataFrame([(1, 1, "a", None, 27, "8", 27), (2, 1, "a", "r", 26, "9", 26), (4, 1, "a", "r", 25, "1", 25), (3, 1, "a", "r", 27, "2", 27)], schema + ", __height bigint")
    log = spark.createDataFrame([(1, 1, "a", None, 26), (2, 1, "a", "r", 26), (4, 1, "a", "r", 26), (3, 1, "a", "r", 9)],
                                "source_id int, signing_pubkey_id int, reward_type string, round_reference string, block_index bigint")
    tables = {"validator_rewards": old, "anchor_reward_reconcile_log": log}
    got = apply.apply_changes(tables, {"validator_rewards": new}, {}, (25, 27))["validator_rewards"]
    # 1 is taken away at 26 and earned again at 27; 2 and 4 landed up to their log row; 3's log row is outside the window
    assert sorted((r.source_id, r.amount) for r in got.collect()) == [(1, "8"), (3, "7")]


def test_halt_stays_through_other_verdicts(spark, tmp_path):
    root = str(tmp_path)
    pipeline.record_verdict(spark, root, "halt", 5, "bad")
    pipeline.record_verdict(spark, root, "gap", 9, "later")
    assert pipeline.active_halt(spark, root) == "bad"
    pipeline.record_verdict(spark, root, "clear", None, "operator")
    assert pipeline.active_halt(spark, root) is None


@pytest.mark.parametrize("fork", [6, 8])
def test_stream_follows_a_reorg(spark, tmp_path, fork):
    """Versions end at 5 and 9: a fork at 6 only branches, one at 8 rolls rows back."""
    root, source = str(tmp_path / "db"), str(tmp_path / "in")
    seeded(spark, root)
    old, new = chained(spark, range(1, 10)), merged(spark, fork, 11)
    query = pipeline.run_pipeline(pipeline.payload_source(spark, source, 1), root, str(tmp_path / "cp"), reorg=True) if write_payload(old, range(1, 6), f"{source}/a") is None else None
    try:
        query.processAllAvailable()
        write_payload(old, range(6, 10), f"{source}/b")
        query.processAllAvailable()
        check_same(spark, root, {t: old[t] for t in new})
        write_payload(new, range(fork, 12), f"{source}/c")
        query.processAllAvailable()
    finally:
        query.stop()
    check_same(spark, root, new)
    seen = {r.kind: r for r in pipeline.verdicts(spark, root).collect()}
    assert set(seen) == {"reorg"} and seen["reorg"].block_index == fork
    stats = {r.version: r for r in versions.version_stats(spark, root).collect()}
    assert [r.version for r in stats.values() if r.discarded] == ([2] if fork == 6 else [])
    if fork == 6:
        assert stats[3].kind == "rollback" and stats[3].n_bytes == 0


def test_too_deep_a_reorg_halts(spark, tmp_path):
    root = str(tmp_path / "db")
    seeded(spark, root)
    rows = payload({t: chained(spark, range(1, 5))[t] for t in ("blocks", "credits")}, range(1, 5))
    pipeline.apply_batch(spark, root, rows)
    other = payload({t: merged(spark, 1, 5)[t] for t in ("blocks", "credits")}, range(1, 6))
    with pytest.raises(pipeline.Halted, match="too deep"):
        pipeline.apply_batch(spark, root, other, reorg=True, max_depth=3)
    assert pipeline.load_tables(spark, root)["blocks"].count() == 5
    pipeline.record_verdict(spark, root, "clear", None, "operator")
    assert pipeline.apply_batch(spark, root, other, reorg=True, max_depth=4) is not None
    assert pipeline.load_tables(spark, root)["blocks"].where("ledger_hash like 'b%'").count() == 5


def test_stream_catches_up_and_survives_crashes(spark, tmp_path, monkeypatch):
    """One crash between parts and manifest, one between manifest and the stream's commit, and a gap."""
    root, source, store = str(tmp_path / "db"), str(tmp_path / "in"), str(tmp_path / "all")
    seeded(spark, root)
    full = chained(spark, range(1, 10))
    write_payload(full, range(1, 10), f"{store}/x")
    write_payload(full, range(1, 3), f"{source}/a")
    crashes = ["publish", "after"]
    publish = versions._publish

    def failing(*args, **kw):
        if crashes and crashes[0] == "publish":
            crashes.pop(0)
            raise RuntimeError("crash before the manifest")
        return publish(*args, **kw)

    def after(version):
        if crashes:
            crashes.pop(0)
            raise RuntimeError("crash after the manifest")

    monkeypatch.setattr(versions, "_publish", failing)

    def follow():
        query = pipeline.run_pipeline(pipeline.payload_source(spark, source, 1), root, str(tmp_path / "cp"), on_version=after,
                                      fetch=pipeline.range_source(spark, store), reorg=True)
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    for message in ("before the manifest", "after the manifest"):
        with pytest.raises(Exception, match=message):
            follow()
    assert versions.latest_version(spark, root) == 1
    follow()  # the published batch comes again and is recognised
    assert versions.latest_version(spark, root) == 1
    write_payload(full, range(6, 8), f"{source}/b")  # 3 to 5 were never sent
    follow()
    check_same(spark, root, {t: full[t].where("block_index <= 7" if "block_index" in full[t].columns else "action_index < 800") for t in ("blocks", "transactions", "actions", "credits")})
    assert [f["batch"].rpartition("/")[2] for f in versions.chain(spark, root, 2) if f["batch"]] == ["1", "0"]


def test_window_payload_feeds_apply(spark, tmp_path):
    root = str(tmp_path / "db")
    full = build(spark, range(0, 9), debit="3")
    full["blocks"] = full["blocks"].withColumns({"ledger_hash": F.lit("h"), "state_hash": F.lit("s")})
    full["bets"] = spark.createDataFrame([(100, 7, 4), (200, 7, 6), (300, 7, None)], "action_index bigint, bet_status_id int, settled_block bigint")
    base = {t: df.where("action_index < 400") if "action_index" in df.columns else df.where("block_index < 4") if t in ("blocks", "transactions") else df for t, df in full.items()}
    base["bets"] = full["bets"].withColumns({"bet_status_id": F.when(F.col("settled_block").isNotNull(), 1).otherwise(F.col("bet_status_id")), "settled_block": F.lit(None).cast("bigint")})
    base["index_addresses"] = full["index_addresses"].where("id < 4")
    base["balances"] = agg.balances(base["credits"], base["debits"])
    versions.write_version(spark, root, base, 3)
    statuses = spark.createDataFrame([(1, "valid")], "id bigint, status string")
    rows = apply.window_payload(full, 4, 8, None, "TOKEN", statuses)
    assert sorted((r.block_index, r.channel) for r in rows.where("table = 'bets'").collect() if r.channel == "updated") == [(4, "updated"), (6, "updated")]
    assert pipeline.apply_batch(spark, root, rows, verify=False) == 1
    got = pipeline.load_tables(spark, root)
    want = dict(full)
    want["blocks"] = full["blocks"].withColumn("state_hash", F.when(~F.col("block_index").between(4, 7), "s"))
    assert as_sets({t: got[t] for t in want}) == as_sets(want)
    assert as_sets({"b": got["balances"]}) == as_sets({"b": agg.balances(full["credits"], full["debits"])})
