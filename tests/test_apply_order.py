"""Apply keeps every row, takes the last update of a key, and refuses forks and gaps; exact quorum."""

from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from blockloom.functions.canon import encode_binary_json
from blockloom.operators import apply, scan, stake
from blockloom.sources.versions import read_table, write_version
from blockloom.streaming import pipeline
from tests.ledger import as_sets, build


getcontext().prec = 100


def change(df, table, block, channel="data"):
    return encode_binary_json(df).select(F.lit(block).cast("bigint").alias("block_index"), F.lit(table).alias("table"), F.lit(channel).alias("channel"), "row_json")


@pytest.mark.parametrize("pairs,meets", [
    ([("2.00000001", True), ("1.00000000", False)], True),
    ([("66.66666667", True), ("33.33333333", False)], True),
    ([("2.0000000001", True), ("1", False)], True),
    ([("2", True), ("1", False)], False),
    ([("5", True), ("1" + "0" * 31, False)], False),
    ([("2" + "0" * 40 + ".000000000000000001", True), ("1" + "0" * 40, False)], True),
    ([("5", True), ("1" + "0" * 60, False)], False),
])
def test_quorum_is_exact(spark, pairs, meets):
    members = spark.createDataFrame([(1, f"k{i}", f"s{i}", w, False) for i, (w, _) in enumerate(pairs)], "seq int, pubkey string, source string, weight string, truncated boolean")
    signers = spark.createDataFrame([(1, f"K{i}") for i, (_, s) in enumerate(pairs) if s], "seq int, pubkey string")
    row = stake.stake_quorum(members, signers, ["seq"]).first()
    assert row.meets_quorum is meets
    if all(len(w) < 50 for w, _ in pairs):
        assert Decimal(row.total_stake) == sum(Decimal(w) for w, _ in pairs)


def test_null_identity_merges_once(spark):
    base = spark.createDataFrame([(1, None), (2, 7)], "a int, b int")
    extra = spark.createDataFrame([(1, None), (2, 7), (3, None), (3, None)], "a int, b int")
    assert sorted(map(tuple, scan.merge_side_channel(base, extra, ["a", "b"]).collect()), key=repr) == [(1, None), (2, 7), (3, None)]


def test_last_update_wins(spark):
    old = spark.createDataFrame([(1, 5), (2, 6)], "action_index int, amount int")
    new = spark.createDataFrame([(1, 9, 26), (1, 8, 27)], "action_index int, amount int, __height int")
    assert sorted(map(tuple, apply.upsert(old, new, ["action_index"]).collect())) == [(1, 8), (2, 6)]


@pytest.fixture
def rewards(spark):
    return spark.createDataFrame([(1, 1, "a", None, 4, "5")], "source_id int, signing_pubkey_id int, reward_type string, round_reference string, block_index bigint, amount string")


def test_buckets_lose_nothing(spark, tmp_path, rewards):
    base = build(spark, range(20, 26)) | {"validator_rewards": rewards.limit(0)}
    news = build(spark, [26])
    batch = change(news["blocks"], "blocks", 26).unionByName(change(rewards, "validator_rewards", 26)) \
        .unionByName(change(spark.createDataFrame([(9, "addr9", None)], "id bigint, address string, block_index bigint"), "index_addresses", 26))
    stores = []
    for width in (None, 10):
        root = str(tmp_path / f"w{width}")
        write_version(spark, root, base, 25, width)
        assert pipeline.apply_batch(spark, root, batch, width) == 1
        stores.append(as_sets(pipeline.load_tables(spark, root)))
    assert stores[0] == stores[1]
    assert len(stores[0]["validator_rewards"]) == 1 and len(stores[0]["index_addresses"]) == 6


def test_fork_and_gap_are_refused(spark, tmp_path):
    root = str(tmp_path / "store")
    base = build(spark, range(1, 6))
    base["blocks"] = base["blocks"].withColumn("ledger_hash", F.concat(F.lit("h"), "block_index"))
    write_version(spark, root, base, 5)
    block = lambda b, h: change(spark.createDataFrame([(b, 0, h)], "block_index bigint, block_time bigint, ledger_hash string"), "blocks", b)
    assert pipeline.apply_batch(spark, root, block(5, "h5")) is None
    with pytest.raises(pipeline.NeedsCatchUp, match="fork at 5"):
        pipeline.apply_batch(spark, root, block(5, "other"))
    with pytest.raises(pipeline.NeedsCatchUp, match="gap after 5"):
        pipeline.apply_batch(spark, root, block(9, "h9"))
    assert pipeline.load_tables(spark, root)["blocks"].count() == 5
    assert sorted(r.kind for r in pipeline.verdicts(spark, root).collect()) == ["fork", "gap"]
    assert pipeline.apply_batch(spark, root, block(6, "h6")) == 1


def test_windowed_read_has_new_columns(spark, tmp_path):
    root = str(tmp_path / "evolved")
    write_version(spark, root, {"t": spark.createDataFrame([(1, 1), (11, 2)], "block_index bigint, v int")}, 11, 10)
    write_version(spark, root, {"t": spark.createDataFrame([(21, 3, 4)], "block_index bigint, v int, w int")}, 21, 10, {"t": [2]})
    near = read_table(spark, root, "t", window=(1, 9), bucket_width=10)
    assert near.columns == ["block_index", "v", "w"] and list(map(tuple, near.collect())) == [(1, 1, None)]
    assert read_table(spark, root, "t").count() == 3
