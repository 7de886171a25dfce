"""What only shows beyond the small tables: late heights, many rows of one identity."""

import hashlib
import os
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from blockloom.fixed_values import ADDRESS_ROLES
from blockloom.operators import changes, integrity, merkle, smt
from blockloom.plans import commitments
from blockloom.session import ensure_checkpoint_dir
from blockloom.sources.compare import TABLES, difference, duck_connection
from tests.test_scale_shapes import tree

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """A folder with the small tables, for a test to put its own in place of some."""
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    return tmp_path


def put(folder, name, select):
    os.unlink(folder / f"{name}.parquet")
    duckdb.execute(f"COPY (SELECT {select} FROM '{SF}/{name}.parquet') TO '{folder / name}.parquet' (FORMAT parquet)")


def test_bets_settled_long_after_the_last_block_are_applied(spark, tables):
    put(tables, "events", "* REPLACE (event_id + 400000 AS event_id)")
    got = entry.queries()["apply_window"](spark, str(tables))
    assert difference(got, duck_connection(str(tables)), entry.oracle_sql()["apply_window"]) is None


REWARD = "source_id bigint, signing_pubkey_id bigint, reward_type string, round_reference bigint, amount string, block_index bigint, derive_block_index bigint"


def test_reward_of_an_identity_is_the_greatest_amount_and_height_text(spark):
    rows = spark.createDataFrame([(1, 2, "A", None, "50", 1150, 1160), (1, 2, "A", None, "5", 1100, 1110), (1, 2, "A", None, "5", 1120, 1121)], REWARD)
    assert [(r.amount, r.block_index) for r in changes.derived_rewards(rows, 1100, 1200).collect()] == [("5", 1120)]
    pending = rows.select("source_id", "reward_type", "round_reference", "amount", "block_index", F.lit("pk").alias("validator_pubkey"),
                          F.lit(1).alias("applied"), F.col("derive_block_index").alias("applied_block"))
    keys = spark.createDataFrame([(2, "pk")], "id bigint, pubkey string")
    assert [(r.amount, r.block_index) for r in changes.redriven_rewards(rows, pending, keys, 1100, 1200).collect()] == [("5", 1120)]


def test_block_roots_and_proofs_of_blocks_in_many_tasks(spark, request):
    """Blocks of many sizes cut by task borders: one tree per block whatever the cuts, and no shuffle after the sort."""
    sizes = {1: 5000, 2: 1, 3: 1024, 4: 1025, 5: 7, 6: 333}
    rows = [(b, i % 4, 10 * i, hashlib.sha256(f"{b}/{i}".encode()).hexdigest()) for b, n in sizes.items() for i in range(n)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "block_index bigint, rank int, n1 bigint, leaf string").withColumns(
        {c: F.lit(None).cast("bigint" if c[0] == "n" else "string") for c in merkle.ORDER if c != "n1"})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as they are, the rows stay in several tasks
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    assert merkle.sorted_leaves(df).cut
    want = {b: [x for _, _, x in sorted((r, n, x) for k, r, n, x in rows if k == b)] for b in sizes}
    placed = merkle.block_positions(df)
    got = {b: [None] * n for b, n in sizes.items()}
    for r in placed.collect():
        got[r.block_index][r.position] = r.leaf
    assert got == want
    proofs = merkle.block_inclusion_proofs(df)
    again = merkle.verify_inclusion(proofs.drop("verified")).collect()
    assert len(again) == len(rows) and all(r.verified and r.leaf == want[r.block_index][r.position] and r.root == tree(want[r.block_index]) for r in again)
    assert proofs.where("not verified").count() == 0
    assert "Exchange" not in proofs._jdf.queryExecution().executedPlan().toString()


def test_a_block_of_more_than_4096_leaves_has_one_root(spark, tables):
    """The registered SQL folds 12 levels and stops at several nodes there; the same SQL with 14 levels reaches the root."""
    put(tables, "orders", "* REPLACE (TIMESTAMP '1996-01-01' AS o_orderdate)")
    con = duck_connection(str(tables))
    short, deep = commitments.node_sql(), commitments.node_sql(14)
    for name in ("block_merkle_proofs", "block_merkle_root"):
        sql = entry.oracle_sql()[name]
        got = entry.queries()[name](spark, str(tables))
        assert difference(got, con, sql.replace(short, "%TREE%").replace("w12", "w14").replace("%TREE%", deep)) is None
        assert con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] > got.count()


def test_positions_keep_less_than_a_hash_of_a_leaf(spark, tables):
    """Sorted rows are kept as what their leaves are made from; orders that are there twice count as the SQL has it."""
    os.unlink(tables / "orders.parquet")
    duckdb.execute(f"COPY (SELECT o.* FROM '{SF}/orders.parquet' o, range(CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 1 END)) TO '{tables / 'orders.parquet'}' (FORMAT parquet)")
    ensure_checkpoint_dir(spark)
    kept = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in kept.rglob("*") if f.is_file())
    before = size()
    got = entry.queries()["block_leaf_positions"](spark, str(tables))
    assert 0 < size() - before < 20 * got.count()
    con = duck_connection(str(tables))
    assert difference(got, con, entry.oracle_sql()["block_leaf_positions"]) is None
    assert difference(entry.queries()["block_merkle_root"](spark, str(tables)), con, entry.oracle_sql()["block_merkle_root"]) is None


def test_late_leaves_lie_as_leaves_do(spark):
    """Whatever is made after the shuffle: roles, nulls, actions of one index, ledger rows that are equal, state rows."""
    rows = [(1, 7 + i % 3, i % 2 or None, str(i % 5)) for i in range(60)]
    frame = spark.createDataFrame
    ledger = frame(rows, "block_index bigint, action_index bigint, address_id bigint, amount string").withColumn("tick_id", F.col("address_id"))
    tables = {"credits": ledger, "escrows": ledger.where("action_index > 7"),
              "actions": frame([(1, 7, i or None, a) for i in range(4) for a in ("SEND", None)], "block_index bigint, action_index bigint, tx_index bigint, action string"),
              "contract_state": frame([(i, 1, i % 3, f"k{i}", str(i)) for i in range(9)], "id bigint, block_index bigint, contract_index bigint, state_key string, state_value string"),
              "index_addresses": frame([(1, next(iter(ADDRESS_ROLES)))], "id bigint, address string"), "index_tickers": frame([(1, "T")], "id bigint, tick string")}
    plain, late = merkle.block_leaves(tables), merkle.block_leaves(tables, late=True)
    assert late.where("rank < 4 and leaf is not null").count() == 0
    placed = [sorted(map(tuple, merkle.block_positions(df).collect())) for df in (plain, late)]
    assert placed[0] == placed[1] and len(placed[0]) == plain.count()
    proofs = [sorted(map(tuple, merkle.block_inclusion_proofs(df, siblings=False).collect())) for df in (plain, late)]
    assert proofs[0] == proofs[1]


def test_paths_and_checks_hash_only_what_is_not_known(monkeypatch):
    """Below a lone leaf all siblings are empty: a path looks at its real forks, a check of absence hashes down to the lowest only."""
    names = [hashlib.sha256(f"k{i}".encode()).hexdigest() for i in range(64)]
    sub = smt._Subtree(names, names)
    root = sub.node(0, 64, 0).hex()
    splits = []
    monkeypatch.setattr(sub, "split", lambda *a, split=sub.split: splits.append(a) or split(*a))
    for key in (names[5], hashlib.sha256(b"none").hexdigest()):
        siblings, leaf = sub.path(bytes.fromhex(key), 0)
        assert len(siblings) == 256 and (leaf is None) == (key not in names)
        bitmap, real = smt.compress(siblings)
        assert smt.decompress(bitmap, real) == siblings
        args = [key, leaf.hex() if leaf else None, bitmap.hex(), [x.hex() for x in real]]
        assert smt._implied_root(*args).hex() == root
        assert smt._implied_root(key, hashlib.sha256(b"x").hexdigest(), *args[2:]).hex() != root
        with pytest.raises(ValueError):
            smt._implied_root(*args[:3], args[3][:-1])
    assert len(splits) < 60


def test_digest_rows_are_shuffled_twice_only(spark):
    """Once to count copies and once to fold the two finest levels; digests of what is below are few."""
    rows = spark.range(300).select("id", (F.col("id") % 7).cast("string").alias("text"))
    plan = integrity.content_digests({"a": rows, "b": rows.unionByName(rows)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4
