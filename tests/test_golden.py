"""Published digests of the protocol, recomputed from their input rows."""

import pytest
from pyspark.sql import functions as F

from blockloom.functions import canon
from blockloom.operators import integrity, merkle, smt

# --- Fixed values: published input rows and digests ---------------------------------------------
A_MAIN, A_ADMIN, A_GEN, A_BOAT = ("1JDogZS6tQcSxwfxhv6XKKjcyicYA4Feev", "1AdminZS6tQcSxwfxhv6XKKjcyicYA4Fee",
                                  "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT")
A_OTHER = "1FuckButtZ6tQcSxwfxhv6XKKjcyiabcde"
LEDGER = "b877b7b65bae57b5f7db81a32013bc69afea70549f7bf1fe7e6dccd82929acdc"
ACTIONS = "a87f2987494bbe53eafdddaf8a6d5fea0672a9cded1c8ad157f107181d5bae36"
CONTRACT = "2e473721e1df1581a90e7e8fa57bf5928b166fe1e5efab79efacc3f88b0da0dd"
STATE = "7d99b6756840c44e1e93d02e91710e77e809688216e4af54748adfe51965c8c8"
EMPTY = {0: "7d0eefdcd395118b3a5c35e09d967d4c8f3ccc6db2a7ba96fbb4a9689d9151dd",
         1: "f883205469c0b06a6e429f91fe4dc4fb27b76ce7cc97606fb777dc3a2205550c",
         255: "2d4c4f019ddb70dc0e833b8828f9e58947eba161d2a4cd8849e741a8ade8c06e",
         256: "c59a65441e85aa19393ca1ecf1c6d9e92bd5250dac74318a264eefb0dc0595a8"}
LEAF_HELLO = "8a2a5c9b768827de5a9552c38a044c66959c68f6d2f21b5260af54d2f87db827"
BALANCES = [(A_MAIN, "XCHAIN", "1000.5"), (A_OTHER, "JDOG", "0.000000000000000001"), (A_GEN, "XCHAIN", "42"),
            (A_BOAT, "PEPE", "7777777.123456789012345678")]
BALANCES_ROOT = "9d6c046a4a5918eb50f79e09ed61fa0c575f64ac0e684c3d2d553d8f6c03bca1"
BALANCES_AFTER_DELETE = "56579813303cb7b290d40a3c94ce93822ebdf24b59670ebf7d54f43df3aed743"
STAKES = [("02a1b2c3d4e5f60718293a4b5c6d7e8f90a1b2c3d4e5f60718293a4b5c6d7e8f901", "oracle_publish", "5000"),
          ("03f1e2d3c4b5a6978869504132231415e6d7c8b9a0f1e2d3c4b5a697886950413", "cross_chain", "3000")]
STAKES_ROOT = "ca218380752dbfda0c0a51a30de71578fbd668fda2830c1b6713afabac7550dc"
STATE_ROOT = "9bd666dde6b461ce93a8b3d42cde43c27735d1093543498d07c8e4eb74cfbcd3"
SLOT_PATH = [STAKES_ROOT, "7cea8987bbc711deebe72e5a5238482c2ef6d20455e02225c5fe3cfbfbd43226",
             "38d4beabe8d6a4ee8903bbfff449322c0dc7f4b53a12775faa9bb4dee9e20b0f"]
MEMBER_LEAF = "e3669b6569cf7df2286807720b1bafa1f989098ef4636a1b0511f28a02eb4d6d"
MEMBER_PROOF = ("c0" + "0" * 62, ["dd037f60dfcba6c47d2a47c4c152e19834d38b7f8c11d0b3fcd7bc86cbb4dd5f",
                                  "a5d0dfba5747ca9fc90f32f514039b699a680bf1e8ed1042bfe209db6a54d0d6"])
ABSENT_PROOF = ("e0" + "0" * 62, ["dd037f60dfcba6c47d2a47c4c152e19834d38b7f8c11d0b3fcd7bc86cbb4dd5f",
                                  "0dbf2c13017bfa4b4eb4caf47571f789f74e5a387e293e04860b5f7c5bceb06d",
                                  "e0382fbe03d21f2299987faaf63f8bfc76246a1d548b6e1c187c7bb1b2d7ed7a"])
BLOCK_ROOT = "65125d4275d35a4456c19553628fbe5a68a8b744f1d1d4f88d8bdfb51b144d09"
BLOCK_PROOF = ["451dfad590f0c9b1336098d99bc80804b33af1b375b10cca7661df3cfdd36486",
               "aa9dd5bfe685bffafa01008ed3d08cf7531f561e5a88fd50ae490c6fae0c8e9c",
               "6a9ff80d5660476b4517b937bf01907fb28a1ce2ec3667dce09c466553df5be9"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_constants(spark):
    for h, want in EMPTY.items():
        assert canon.EMPTY_ROOTS[h].hex() == want
    row = spark.range(1).select(canon.leaf_hash(F.lit("hello")), canon.node_hash(F.lit(EMPTY[0]), F.lit(EMPTY[0]))).first()
    assert row[0] == LEAF_HELLO and row[1] == EMPTY[1]


def test_block_hashes(spark):
    b = 1000
    ledger = "action_index bigint, address string, tick string, amount string, block_index bigint"
    tables = {
        "credits": frame(spark, [(3, A_OTHER, "JDOG", "500", b), (1, A_MAIN, "JDOG", "1000", b)], ledger),
        "debits": frame(spark, [(1, A_ADMIN, "JDOG", "1500", b)], ledger),
        "escrows": frame(spark, [], ledger),
        "actions": frame(spark, [(2, 1, "DEPLOY", b), (1, 1, "SEND", b), (3, 2, "SEND", b)], "action_index bigint, tx_index bigint, action string, block_index bigint"),
        "contracts": frame(spark, [(2, A_ADMIN, "deadbeefcafe", "deployed", b)], "action_index bigint, source_address string, code_hash string, status string, block_index bigint"),
        "contract_state": frame(spark, [(1, 2, "owner", "old", b), (2, 2, "counter", "42", b), (3, 2, "owner", "abc", b)],
                                "id bigint, contract_index bigint, state_key string, state_value string, block_index bigint"),
        "contract_executions": frame(spark, [(3, 2, A_OTHER, "12345", "success", 1, b)],
                                     "action_index bigint, contract_index bigint, caller_address string, gas_used string, status string, emitted_count int, block_index bigint"),
        "contract_emissions": frame(spark, [(3, "EXECUTE", 3, 0)], "execution_index bigint, emitted_action string, action_index bigint, position int"),
        "deposits": frame(spark, [(1, 2, A_MAIN, "JDOG", "1000", "success", b)],
                          "action_index bigint, contract_index bigint, source_address string, tick string, amount string, status string, block_index bigint"),
    }
    blocks = frame(spark, [(999, "prevLedgerHash", "prevActionsHash", "prevContractsHash"), (1000, None, None, None)],
                   "block_index bigint, ledger_hash string, actions_hash string, contract_hash string")
    row = integrity.block_hashes(tables, blocks).where("block_index = 1000").first()
    assert (row.ledger_hash, row.actions_hash, row.contract_hash) == (LEDGER, ACTIONS, CONTRACT)
    seeds = {"ledger": "prevLedgerHash", "actions": "prevActionsHash", "contracts": "prevContractsHash"}
    row = integrity.commit_block_hashes(tables, blocks.where("block_index = 1000"), seeds).first()
    assert (row.ledger_hash, row.actions_hash, row.contract_hash) == (LEDGER, ACTIONS, CONTRACT)


def test_chain_commits_what_verification_recomputes(spark):
    ledger = "action_index bigint, address string, tick string, amount string, block_index bigint"
    rows = [(b * 10 + i, f"a{i}", "T", str(b * i), b) for b in range(1, 30) for i in range(b % 4)]
    tables = {"credits": frame(spark, rows, ledger), "debits": frame(spark, rows[::2], ledger),
              "actions": frame(spark, [(b * 10, None, "SEND", b) for b in range(1, 30)], "action_index bigint, tx_index bigint, action string, block_index bigint")}
    blocks = frame(spark, [(b,) for b in range(1, 30)], "block_index bigint")
    zero = {"ledger": "l0", "actions": "a0", "contracts": "c0"}
    committed = integrity.commit_block_hashes(tables, blocks, zero)
    seed = frame(spark, [(0, "l0", "a0", "c0")], committed.schema)
    again = integrity.block_hashes(tables, committed.unionByName(seed)).where("block_index > 0")
    assert integrity.compare_block_hashes(again, committed).count() == 0
    assert again.count() == 29
    broken = dict(tables, credits=tables["credits"].where("action_index <> 111"))
    bad = integrity.compare_block_hashes(integrity.block_hashes(broken, committed.unionByName(seed)).where("block_index > 0"), committed)
    assert [(r.block_index, r.field) for r in bad.collect()] == [(11, "ledger_hash")]


def test_state_hash(spark):
    stamp = "action_index bigint, deactivation_block bigint"
    tables = {
        "index_statuses": frame(spark, [(7, "completed"), (1, "valid")], "id bigint, status string"),
        "stakes": frame(spark, [(10, 1006, "5"), (12, None, "900")], "action_index bigint, deactivation_block bigint, amount string"),
        "contract_stakes": frame(spark, [(11, 1006)], stamp),
        "capability_slash_debits": frame(spark, [(12, "stakes", 1000), (12, "stakes", 1000)], "stake_action_index bigint, target_table string, block_index bigint"),
        "contract_slash_debits": frame(spark, [(13, "contract_unstakes", 1000)], "stake_action_index bigint, target_table string, block_index bigint"),
        "attests": frame(spark, [(14, 0, "fulfilled", 1000), (24, 1, "fulfilled", 1000)], "action_index bigint, version int, request_status string, resolved_block bigint"),
        "xcalls": frame(spark, [(15, 0, "expired", 1000)], "action_index bigint, version int, request_status string, resolved_block bigint"),
        "unstakes": frame(spark, [(16, 1, 7, 1000)], "action_index bigint, source_id bigint, status_id bigint, cooldown_end_block bigint"),
        "contract_unstakes": frame(spark, [(17, 2, 2, 7, 1000, None), (13, 9, 9, 1, 5, "50")],
                                   "action_index bigint, source_id bigint, tick_id bigint, status_id bigint, cooldown_end_block bigint, amount string"),
        "credits": frame(spark, [(16, 1, 1, "1000"), (17, 2, 2, "500"), (99, 1, 1, "7")], "action_index bigint, address_id bigint, tick_id bigint, amount string"),
        "index_addresses": frame(spark, [(1, A_MAIN), (2, A_OTHER)], "id bigint, address string"),
        "index_tickers": frame(spark, [(1, "XCHAIN"), (2, "JDOG")], "id bigint, tick string"),
    }
    blocks = frame(spark, [(1000,)], "block_index bigint")
    # The published document predates every optional key.
    omit = ("anchor_invalid", "index_addresses_new", "index_tickers_new", "poll_finalize", "token_supply", "bet_feed_status", "bet_status")
    assert integrity.state_hashes(tables, blocks, 6, None, "none", "XCHAIN", omit).first().state_hash == STATE
    # Dropping one mutation is noticed.
    less = dict(tables, attests=tables["attests"].where("action_index <> 14"))
    assert integrity.state_hashes(less, blocks, 6, None, "none", "XCHAIN", omit).first().state_hash != STATE


def balance_leaves(spark, rows):
    df = frame(spark, rows, "address string, tick string, amount string")
    key = canon.balance_key(F.lit("BTC"), F.lit("regtest"), F.col("address"), F.col("tick"))
    return df.select(key.alias("key"), canon.amount_leaf(F.col("amount")).alias("leaf"))


@pytest.fixture(scope="module")
def published():
    return BALANCES


def test_balances_root_and_delete(spark, published):
    leaves = balance_leaves(spark, published)
    assert smt.smt_root(leaves).first().root == BALANCES_ROOT
    kept = balance_leaves(spark, [r for r in published if r[0] != A_GEN])
    assert smt.smt_root(kept).first().root == BALANCES_AFTER_DELETE
    gone = balance_leaves(spark, [r for r in published if r[0] == A_GEN]).select("key")
    threaded = smt.update_prefix_roots(smt.prefix_roots(leaves), kept, gone)
    assert smt.combine(threaded).first().root == BALANCES_AFTER_DELETE
    assert smt.smt_root(leaves.limit(0)).first().root == EMPTY[256]


def test_membership_proofs(spark, published):
    leaves = balance_leaves(spark, published)
    absent = balance_leaves(spark, [("1NOTPRESENTxxxxxxxxxxxxxxxxxxxxxxxx", "GHOST", "1")]).select("key")
    member = balance_leaves(spark, [published[0]]).select("key")
    rows = {r.key: r for r in smt.smt_proofs(leaves, member.unionByName(absent)).collect()}
    m, a = rows[member.first().key], rows[absent.first().key]
    assert m.leaf_value == MEMBER_LEAF and (m.bitmap, m.siblings) == MEMBER_PROOF
    assert a.leaf_value is None and (a.bitmap, a.siblings) == ABSENT_PROOF
    assert m.root == BALANCES_ROOT


def test_state_root(spark):
    df = frame(spark, STAKES, "pubkey string, capability string, amount string")
    leaves = df.select(canon.stake_key(F.col("pubkey"), F.col("capability")).alias("key"), canon.amount_leaf(F.col("amount")).alias("leaf"))
    assert smt.smt_root(leaves).first().root == STAKES_ROOT
    slots = {"balances_root": F.lit(BALANCES_ROOT), "stakes_root": F.lit(STAKES_ROOT)}
    row = spark.range(1).select(canon.state_root(**slots), canon.state_root_proof("balances_root", **slots),
                                canon.fold_proof(F.lit(BALANCES_ROOT), F.lit(0), canon.state_root_proof("balances_root", **slots))).first()
    assert row[0] == STATE_ROOT and row[1] == SLOT_PATH and row[2] == STATE_ROOT


def test_block_merkle_root(spark):
    b, schema = 5, "action_index bigint, address string, tick string, amount string, block_index bigint"
    tables = {"credits": frame(spark, [(10, A_MAIN, "XCHAIN", "1000.5", b)], schema), "debits": frame(spark, [(10, A_GEN, "XCHAIN", "42", b)], schema),
              "escrows": frame(spark, [(12, A_BOAT, "PEPE", "-5", b), (11, A_BOAT, "PEPE", "5", b)], schema),
              "actions": frame(spark, [(10, 0, "SEND", b), (11, None, "ORDER", b)], "action_index bigint, tx_index bigint, action string, block_index bigint")}
    blocks = frame(spark, [(5,), (6,)], "block_index bigint")
    rows = {r.block_index: r for r in merkle.block_merkle_roots(tables, blocks).collect()}
    assert rows[5].block_merkle_root == BLOCK_ROOT and rows[5].leaf_count == 6
    assert rows[6].block_merkle_root == EMPTY[0] and rows[6].leaf_count == 0
    placed = merkle.with_positions(merkle.block_leaves(tables), ["block_index"], ["rank", *merkle.ORDER, "leaf"])
    proofs = merkle.verify_inclusion(merkle.inclusion_proofs(placed.select("block_index", "position", "leaf"), ["block_index"])).collect()
    assert all(p.verified for p in proofs) and {p.position: p.siblings for p in proofs}[1] == BLOCK_PROOF
