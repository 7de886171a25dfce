"""Queries of canonical forms, gates and rollback steps that other queries only use in part."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.fixed_values import CHECKPOINT_TAG, EQUIVOCATION_PREFIX
from blockloom.functions import canon, gates
from blockloom.operators import integrity, rollback, scan
from blockloom.plans.integrity import digest_sql
from blockloom.plans.registry import query
from blockloom.plans.snapshots import BLOCK_COLUMNS
from blockloom.sources.driver_model import ACTION_SPAN


@query("backoff_delays", """SELECT o_orderkey, CAST(least(60000.0, 250.0 * power(2.0, o_orderkey % 15)) AS BIGINT) AS wait_ms FROM orders""")
def backoff_delays(m):
    return m.table("orders").select("o_orderkey", canon.backoff_ms(250, 60_000, F.col("o_orderkey") % 15).alias("wait_ms"))


@query("hash_tuples", """SELECT block_index, coalesce(ledger_hash, 'null') || '|' || coalesce(actions_hash, 'null') || '|' || coalesce(contract_hash, 'null') AS tuple FROM blocks""", ("blocks",))
def hash_tuples(m):
    return m.blocks.select("block_index", canon.hash_tuple(F.col("ledger_hash"), F.col("actions_hash"), F.col("contract_hash")).alias("tuple"))


@query("binary_exchange", """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"b":' || CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE '{"__xbin__":"' || base64(encode(c_name)) || '"}' END || '}' AS row_json,
    CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS back FROM customer""")
def binary_exchange(m):
    """Rows with a binary column as they travel, and as they come back."""
    rows = m.table("customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name").cast("binary")).alias("b"))
    wire = canon.encode_binary_json(rows)
    return canon.decode_binary_json(wire, rows.schema, also=[F.col("row_json")]).select("c_custkey", "row_json", F.col("b").cast("string").alias("back"))


CHECKPOINTS = f"""WITH c AS (SELECT block_index AS b, block_index // 100 AS seq, coalesce(ledger_hash, '') AS l, coalesce(actions_hash, '') AS a, coalesce(contract_hash, '') AS c,
      CASE WHEN block_index % 3 <> 0 THEN upper(ledger_hash) END AS sr, actions_hash AS mr FROM blocks),
    t AS (SELECT *, '{CHECKPOINT_TAG}|BTC|regtest|' || b || '|' || l || '|' || l || '|' || a || '|' || c || '|' || seq || '|' || (b - 6) AS base FROM c)
    SELECT b AS block_index, CASE WHEN b % 5 = 0 THEN '{EQUIVOCATION_PREFIX}|{CHECKPOINT_TAG}|BTC|regtest|' || b || '|' || seq || '|0||' ELSE '' END || base
      || CASE WHEN b % 2 = 0 AND sr IS NOT NULL AND mr IS NOT NULL THEN '|' || lower(sr) || '|1|' || lower(mr) || '|1' ELSE '' END AS text FROM t"""


@query("checkpoint_texts", CHECKPOINTS, ("blocks",))
def checkpoint_texts(m):
    b = F.col("block_index")
    rows = m.blocks.select(
        "block_index", F.lit("BTC").alias("chain"), F.lit("regtest").alias("network"), F.col("ledger_hash").alias("block_hash"), "ledger_hash", "actions_hash", "contract_hash",
        F.floor(b / 100).cast("bigint").alias("checkpoint_seq"), (b - 6).alias("snapshot_block"), F.when(b % 3 != 0, F.upper("ledger_hash")).alias("state_root"),
        F.lit(1).alias("state_root_version"), F.col("actions_hash").alias("block_merkle_root"), F.lit(1).alias("block_merkle_version"))
    return rows.select("block_index", canon.checkpoint_text(b % 2 == 0, b % 5 == 0).alias("text"))


@query("digest_dropped_column", f"WITH {digest_sql({'blocks': ('blocks', BLOCK_COLUMNS)})} SELECT * FROM digests", ("blocks",))
def digest_dropped_column(m):
    """A surrogate id that copies don't share is no part of a digest."""
    return integrity.content_digests({"blocks": m.blocks.withColumn("id", F.col("block_index") * 7 + 3)})


@query("gate_boundary", """SELECT block_index, block_index + 957000 >= 958500 AS active, block_index + 957000 = 958500 AS boundary FROM blocks""", ("blocks",))
def gate_boundary(m):
    at = (F.col("block_index") + 957_000).cast("string")
    return m.blocks.select("block_index", gates.is_active("token_supply_hash", at, "BTC", "mainnet").alias("active"),
                           gates.is_boundary("token_supply_hash", F.col("block_index") + 957_000, "BTC", "mainnet").alias("boundary"))


@query("gated_sub_roots", """SELECT block_index, CASE WHEN block_index + 9000 >= 10000 THEN ledger_hash END AS contract_state_root, CAST(NULL AS VARCHAR) AS tokens_root,
    CAST(CASE WHEN block_index + 9000 >= 10000 THEN 2 ELSE 1 END AS INTEGER) AS version FROM blocks""", ("blocks",))
def gated_sub_roots(m):
    """Sub-roots of reserved slots before and after the height that arms one of them."""
    at = F.col("block_index") + 9_000
    kept = gates.gated_sub_roots({"contract_state_root": F.col("ledger_hash"), "tokens_root": F.col("actions_hash")}, at, "BTC", "regtest")
    return m.blocks.select("block_index", *[c.alias(n) for n, c in kept.items()], gates.state_root_version(at, "BTC", "regtest").cast("int").alias("version"))


@query("schema_checked", """SELECT action_index, block_index FROM actions WHERE block_index BETWEEN 1100 AND 1200""", ("actions",))
def schema_checked(m):
    """A window of rows that travel under the expected schema version; any other version raises."""
    rows = scan.block_scan(m.actions, 1100, 1200).select("action_index", "block_index", F.lit(7).alias("schema_version"))
    return scan.schema_gate(rows, 7).drop("schema_version")


@query("rollback_cross_chain", f"""SELECT action_index, a_chain, b_chain, b_action_index FROM (SELECT action_index, CASE source_id % 3 WHEN 0 THEN 'BTC' WHEN 1 THEN 'LTC' END AS a_chain,
      CASE source_id % 4 WHEN 0 THEN 'BTC' ELSE 'DOGE' END AS b_chain, CASE WHEN source_id % 5 <> 0 THEN action_index + {100 * ACTION_SPAN} END AS b_action_index FROM actions)
    WHERE NOT coalesce(a_chain = 'BTC' AND action_index >= {1200 * ACTION_SPAN}, false) AND NOT coalesce(b_chain = 'BTC' AND b_action_index >= {1200 * ACTION_SPAN}, false)""", ("actions",))
def rollback_cross_chain(m):
    s, a = F.col("source_id"), F.col("action_index")
    rows = m.actions.select("action_index", F.when(s % 3 == 0, "BTC").when(s % 3 == 1, "LTC").alias("a_chain"), F.when(s % 4 == 0, "BTC").otherwise("DOGE").alias("b_chain"),
                            F.when(s % 5 != 0, a + 100 * ACTION_SPAN).alias("b_action_index"))
    return rollback.drop_cross_chain(rows, "BTC", 1200 * ACTION_SPAN, [("a_chain", "action_index"), ("b_chain", "b_action_index")])


@query("rollback_logs", """SELECT 'sync_meta' AS "table", block_index AS key FROM blocks WHERE block_index < 1234
    UNION ALL SELECT 'merkle_epochs', (block_index + 99) // 100 FROM blocks GROUP BY 2 HAVING max(block_index) < 1234
    UNION ALL SELECT 'attest_validator_stats', o_custkey FROM orders_heights GROUP BY o_custkey HAVING max(block_index) < 1234""".replace(
        "orders_heights", "(SELECT source_id AS o_custkey, block_index FROM actions)"), ("blocks", "actions"))
def rollback_logs(m):
    """The log, its epochs and per-validator statistics as the whole rollback leaves them."""
    b = F.col("block_index")
    tables = {"actions": m.actions, "sync_meta": m.blocks.select("block_index"),
              "merkle_epochs": m.blocks.groupBy(F.floor((b + 99) / 100).cast("bigint").alias("epoch")).agg(F.max(b).alias("end_block")),
              "attest_validator_stats": m.actions.groupBy(F.col("source_id").alias("validator_id")).agg(F.max(b).alias("last_updated_block"))}
    new = rollback.rollback_indexer(tables, 1234)
    parts = [new[t].select(F.lit(t).alias("table"), F.col(c).cast("bigint").alias("key")) for t, c in (("sync_meta", "block_index"), ("merkle_epochs", "epoch"), ("attest_validator_stats", "validator_id"))]
    return reduce(DataFrame.unionByName, parts)
