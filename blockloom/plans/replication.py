"""Change capture, write-mode and snapshot queries."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators import apply as ap
from blockloom.functions.canon import encode_binary_json
from blockloom.operators import aggregates as agg
from blockloom.operators import changes, follow, scan
from blockloom.plans.aggregates import SIGNED, TEXT
from blockloom.plans.registry import query
from blockloom.session import ensure_checkpoint_dir
from blockloom.sources import versions
from blockloom.streaming import pipeline
from blockloom.sources.driver_model import ACTIVATION_DELAY, GAS_TICK

LOW, HIGH = 1100, 1200
MUTABLE = ("stakes", "delegations", "unstakes", "contract_unstakes", "attests", "xcalls", "polls", "bet_feeds", "bets",
           "anchors", "slash_debits", "statuses", "tokens", "credits", "debits", "escrows", "actions")


def mutable_tables(m):
    return {"stakes": m.stakes, "delegations": m.delegations, "unstakes": m.unstakes, "contract_unstakes": m.contract_unstakes,
            "attests": m.attests, "xcalls": m.xcalls, "polls": m.polls, "bet_feeds": m.bet_feeds, "bets": m.bets,
            "anchor_actions": m.anchors, "capability_slash_debits": m.slash_debits, "tokens": m.tokens,
            "credits": m.credits, "debits": m.debits, "escrows": m.escrows, "actions": m.actions}


UPDATED = """SELECT 'stakes' AS "table", action_index AS key FROM stakes s WHERE deactivation_block BETWEEN 1106 AND 1206
      OR EXISTS (SELECT 1 FROM slash_debits d WHERE d.stake_action_index = s.action_index AND d.target_table = 'stakes' AND d.block_index BETWEEN 1100 AND 1200)
    UNION ALL SELECT 'delegations', action_index FROM delegations WHERE deactivation_block BETWEEN 1106 AND 1206
    UNION ALL SELECT 'unstakes', action_index FROM unstakes WHERE cooldown_end_block BETWEEN 1100 AND 1200
    UNION ALL SELECT 'contract_unstakes', action_index FROM contract_unstakes WHERE cooldown_end_block BETWEEN 1100 AND 1200
    UNION ALL SELECT 'attests', action_index FROM attests WHERE version = 0 AND resolved_block BETWEEN 1100 AND 1200
    UNION ALL SELECT 'xcalls', action_index FROM xcalls WHERE version = 0 AND resolved_block BETWEEN 1100 AND 1200
    UNION ALL SELECT 'polls', action_index FROM polls WHERE resolved_block BETWEEN 1100 AND 1200 OR (callback_due_block BETWEEN 1100 AND 1200 AND callback_execute_action_index IS NOT NULL)
    UNION ALL SELECT 'bet_feeds', action_index FROM bet_feeds WHERE closed_block BETWEEN 1100 AND 1200 OR terminal_block BETWEEN 1100 AND 1200
    UNION ALL SELECT 'bets', action_index FROM bets WHERE settled_block BETWEEN 1100 AND 1200
    UNION ALL SELECT DISTINCT 'anchor_actions', p.action_index FROM anchors p JOIN anchors c ON c.version = 2 AND c.match_batch_seq = p.match_batch_seq
      JOIN statuses ps ON ps.id = p.status_id AND ps.status = 'invalid_archive' JOIN statuses cs ON cs.id = c.status_id AND cs.status = 'valid'
      WHERE p.version IN (1, 6) AND c.block_index_doge BETWEEN 1100 AND 1200
    UNION ALL SELECT 'tokens', tick_id FROM tokens WHERE tick_id IN (SELECT tick_id FROM credits JOIN actions USING (action_index) WHERE block_index BETWEEN 1100 AND 1200
      UNION SELECT tick_id FROM debits JOIN actions USING (action_index) WHERE block_index BETWEEN 1100 AND 1200
      UNION SELECT tick_id FROM escrows JOIN actions USING (action_index) WHERE block_index BETWEEN 1100 AND 1200)"""


def keyed(frames):
    parts = [df.select(F.lit(t).alias("table"), F.col("tick_id" if t == "tokens" else "action_index").alias("key"))
             for t, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


@query("updated_rows", UPDATED, MUTABLE)
def updated_rows(m):
    return keyed(changes.updated_rows(mutable_tables(m), LOW, HIGH, ACTIVATION_DELAY, m.statuses))


@query("archive_heads", """SELECT DISTINCT p.* FROM anchors p JOIN anchors c ON c.version = 2 AND c.match_batch_seq = p.match_batch_seq
    WHERE p.version IN (1, 6) AND p.status_id = 9 AND c.status_id = 1 AND c.block_index_doge BETWEEN 1100 AND 1200""", ("anchors",))
def archive_heads(m):
    return changes.archive_heads(m.anchors, m.statuses, LOW, HIGH)


MATURED = """SELECT action_index, address_id, tick_id, max(amount) AS amount FROM (
      SELECT c.* FROM credits c JOIN unstakes u ON u.action_index = c.action_index AND u.source_id = c.address_id
        JOIN index_tickers g ON g.id = c.tick_id AND g.tick = 'TICK0' WHERE u.status_id = 3 AND u.cooldown_end_block BETWEEN 1100 AND 1200
      UNION ALL SELECT c.* FROM credits c JOIN contract_unstakes cu ON cu.action_index = c.action_index AND cu.source_id = c.address_id AND cu.tick_id = c.tick_id
        WHERE cu.status_id = 3 AND cu.cooldown_end_block BETWEEN 1100 AND 1200) GROUP BY 1, 2, 3"""


@query("matured_credits", MATURED, ("credits", "unstakes", "contract_unstakes", "index_tickers"))
def matured_credits(m):
    return changes.matured_credits(m.credits, m.unstakes, m.contract_unstakes, m.index_tickers, m.statuses, GAS_TICK, LOW, HIGH)


@query("redriven_rewards", """SELECT source_id, signing_pubkey_id, reward_type, round_reference, max(amount || '|' || lpad(CAST(block_index AS VARCHAR), 9, '0')) AS pick FROM (
    SELECT DISTINCT r.* FROM rewards r JOIN pubkeys k ON k.id = r.signing_pubkey_id JOIN pending_rewards p ON p.source_id = r.source_id AND p.reward_type = r.reward_type
      AND p.round_reference IS NOT DISTINCT FROM r.round_reference AND p.amount = r.amount AND p.block_index = r.block_index AND p.validator_pubkey = k.pubkey
    WHERE p.applied = 1 AND p.applied_block BETWEEN 1100 AND 1200 AND r.block_index < p.applied_block) GROUP BY 1, 2, 3, 4""",
       ("rewards", "pubkeys", "pending_rewards"))
def redriven_rewards(m):
    rows = changes.redriven_rewards(m.rewards, m.pending_rewards, m.pubkeys, LOW, HIGH)
    pick = F.concat("amount", F.lit("|"), F.lpad(F.col("block_index").cast("string"), 9, "0"))
    return rows.select("source_id", "signing_pubkey_id", "reward_type", "round_reference", pick.alias("pick"))


@query("derived_rewards", """SELECT source_id, signing_pubkey_id, reward_type, round_reference, max(amount || '|' || lpad(CAST(block_index AS VARCHAR), 9, '0')) AS pick FROM rewards
    WHERE derive_block_index BETWEEN 1100 AND 1200 AND block_index < derive_block_index GROUP BY 1, 2, 3, 4""", ("rewards",))
def derived_rewards(m):
    rows = changes.derived_rewards(m.rewards, LOW, HIGH)
    pick = F.concat("amount", F.lit("|"), F.lpad(F.col("block_index").cast("string"), 9, "0"))
    return rows.select("source_id", "signing_pubkey_id", "reward_type", "round_reference", pick.alias("pick"))


@query("upsert_merge", """SELECT action_index, 'done' AS request_status, version, resolved_block FROM attests WHERE resolved_block >= 500
    UNION ALL SELECT action_index, request_status, version, resolved_block FROM attests WHERE resolved_block IS NULL OR resolved_block < 500""", ("attests",))
def upsert_merge(m):
    incoming = m.attests.where("resolved_block >= 500").withColumn("request_status", F.lit("done"))
    return ap.upsert(m.attests, incoming, ["action_index"])


@query("insert_ignore", """SELECT id, address FROM index_addresses UNION ALL
    SELECT o_custkey, min('late' || o_orderpriority) FROM orders WHERE o_custkey NOT IN (SELECT id FROM index_addresses) GROUP BY 1""", ("index_addresses",))
def insert_ignore(m):
    incoming = m.table("orders").select(F.col("o_custkey").alias("id"), F.concat(F.lit("late"), "o_orderpriority").alias("address"))
    return ap.insert_ignore(m.index_addresses.select("id", "address"), incoming, ["id"])


@query("replace_natural_key", """SELECT block_index, block_time + 7 AS block_time, 'new' AS ledger_hash FROM blocks WHERE block_index >= 2000
    UNION ALL SELECT block_index, block_time, ledger_hash FROM blocks WHERE block_index < 2000""", ("blocks",))
def replace_natural_key(m):
    existing = m.blocks.select((F.col("block_index") + 10).alias("id"), "block_index", "block_time", "ledger_hash")
    incoming = m.blocks.where("block_index >= 2000").select(
        F.col("block_index").alias("id"), "block_index", (F.col("block_time") + 7).alias("block_time"), F.lit("new").alias("ledger_hash"))
    return ap.replace_by_key(existing, incoming, "block_index")


@query("mirror_delete", """SELECT r.* FROM rewards r WHERE NOT EXISTS (SELECT 1 FROM reconcile_log g WHERE g.block_index BETWEEN 1100 AND 1200 AND g.source_id = r.source_id
    AND g.signing_pubkey_id = r.signing_pubkey_id AND g.reward_type = r.reward_type AND g.round_reference IS NOT DISTINCT FROM r.round_reference)""", ("rewards", "reconcile_log"))
def mirror_delete(m):
    return ap.mirror_delete(m.rewards, m.reconcile_log, LOW, HIGH)


OPEN_OFFERS = """l AS (SELECT kind, offer_action_index, max(action_index) AS last FROM offer_statuses GROUP BY 1, 2),
    o AS (SELECT DISTINCT f.action_index, f.give_tick_id FROM offers f JOIN l ON l.kind = f.kind AND l.offer_action_index = f.action_index
      JOIN offer_statuses s ON s.kind = f.kind AND s.offer_action_index = f.action_index AND s.action_index = l.last
      JOIN statuses n ON n.id = s.status_id AND n.status IN ('open', 'cancelling', 'expiring') WHERE f.give_ownership = 1)"""


@query("escrow_gate", f"""WITH {OPEN_OFFERS} SELECT t.tick_id, t.decimals, t.supply, (SELECT min(action_index) FROM o WHERE o.give_tick_id = t.tick_id) AS escrow_action_index
    FROM tokens t""", ("offers", "offer_statuses", "statuses", "tokens"))
def escrow_gate(m):
    families = [(m.offers(k), m.offer_statuses(k)) for k in range(3)]
    return ap.rederive_escrow_gate(m.tokens, families, m.statuses, m.index_tickers)


SNAP = """SELECT 'credits' AS "table", 'data' AS channel, (SELECT count(*) FROM credits JOIN actions USING (action_index) WHERE block_index BETWEEN 2000 AND 2404)
      + (SELECT count(*) FROM (SELECT DISTINCT c.action_index, c.address_id, c.tick_id FROM credits c LEFT JOIN unstakes u ON u.action_index = c.action_index AND u.source_id = c.address_id AND c.tick_id = 0
          LEFT JOIN contract_unstakes v ON v.action_index = c.action_index AND v.source_id = c.address_id AND v.tick_id = c.tick_id JOIN actions a ON a.action_index = c.action_index
          WHERE ((u.status_id = 3 AND u.cooldown_end_block BETWEEN 2000 AND 2404) OR (v.status_id = 3 AND v.cooldown_end_block BETWEEN 2000 AND 2404)) AND a.block_index < 2000)) AS n_rows
    UNION ALL SELECT 'debits', 'data', count(*) FROM debits JOIN actions USING (action_index) WHERE block_index BETWEEN 2000 AND 2404
    UNION ALL SELECT 'escrows', 'data', count(*) FROM escrows JOIN actions USING (action_index) WHERE block_index BETWEEN 2000 AND 2404
    UNION ALL SELECT 'actions', 'data', count(*) FROM actions WHERE block_index BETWEEN 2000 AND 2404
    UNION ALL SELECT 'blocks', 'data', count(*) FROM blocks WHERE block_index BETWEEN 2000 AND 2404
    UNION ALL SELECT 'transactions', 'data', count(*) FROM transactions WHERE block_index BETWEEN 2000 AND 2404
    UNION ALL SELECT 'unstakes', 'data', count(*) FROM unstakes JOIN actions USING (action_index) WHERE actions.block_index BETWEEN 2000 AND 2404
    UNION ALL SELECT 'contract_unstakes', 'data', count(*) FROM contract_unstakes JOIN actions USING (action_index) WHERE actions.block_index BETWEEN 2000 AND 2404
    UNION ALL SELECT 'index_addresses', 'data', count(*) FROM index_addresses
    UNION ALL SELECT 'index_tickers', 'data', count(*) FROM index_tickers
    UNION ALL SELECT 'unstakes', 'updated', count(*) FROM unstakes WHERE cooldown_end_block BETWEEN 2000 AND 2404
    UNION ALL SELECT 'contract_unstakes', 'updated', count(*) FROM contract_unstakes WHERE cooldown_end_block BETWEEN 2000 AND 2404"""


@query("incremental_snapshot", SNAP, ("credits", "debits", "escrows", "actions", "blocks", "transactions", "unstakes", "contract_unstakes", "index_addresses", "index_tickers"))
def incremental_snapshot(m):
    tables = {"credits": m.credits, "debits": m.debits, "escrows": m.escrows, "actions": m.actions, "blocks": m.blocks,
              "transactions": m.transactions, "unstakes": m.unstakes, "contract_unstakes": m.contract_unstakes,
              "index_addresses": m.index_addresses, "index_tickers": m.index_tickers}
    data, updated = ap.incremental_snapshot(tables, 2000, 2404, ACTIVATION_DELAY, GAS_TICK, m.statuses)
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table"), F.lit(c).alias("channel"), "n_rows")
             for c, frames in (("data", data), ("updated", updated)) for t, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


@query("block_payload", """SELECT 'debits' AS "table", 'data' AS channel, '{"action_index":' || action_index || ',"address_id":' || address_id || ',"tick_id":' || tick_id || ',"amount":"' || amount || '"}' AS row_json
      FROM debits JOIN actions USING (action_index) WHERE block_index BETWEEN 1100 AND 1200
    UNION ALL SELECT 'bets', 'updated', '{"action_index":' || action_index || ',"bet_status_id":' || bet_status_id || ',"settled_block":' || settled_block || '}'
      FROM bets WHERE settled_block BETWEEN 1100 AND 1200""", ("debits", "actions", "bets"))
def block_payload(m):
    data = {"debits": scan.action_scan(m.debits, m.actions, LOW, HIGH).select("action_index", "address_id", "tick_id", "amount")}
    return ap.block_payload(data, changes.updated_rows({"bets": m.bets}, LOW, HIGH, None))


@query("config_merge", """WITH b AS (SELECT l_suppkey AS coin, l_partkey % 5 AS network, l_returnflag AS module, l_linestatus AS param, CAST(max(l_quantity) AS VARCHAR) AS value,
      max(l_orderkey) AS updated_at FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL),
    d AS (SELECT l_suppkey AS coin, l_partkey % 5 AS network, l_returnflag AS module, l_linestatus AS param, CAST(min(l_quantity) AS VARCHAR) AS value,
      min(l_orderkey) AS updated_at FROM lineitem WHERE l_linenumber >= 3 GROUP BY ALL)
    SELECT * FROM d UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.coin = b.coin AND d.network = b.network AND d.module = b.module AND d.param = b.param)""")
def config_merge(m):
    keys = [F.col("l_suppkey").alias("coin"), (F.col("l_partkey") % 5).alias("network"), F.col("l_returnflag").alias("module"), F.col("l_linestatus").alias("param")]
    lines = m.table("lineitem")
    base = lines.where("l_linenumber <= 4").groupBy(*keys).agg(
        F.max("l_quantity").cast("string").alias("value"), F.max("l_orderkey").alias("updated_at"))
    delta = lines.where("l_linenumber >= 3").groupBy(*keys).agg(
        F.min("l_quantity").cast("string").alias("value"), F.min("l_orderkey").alias("updated_at"))
    return scan.config_merge(base, delta)


WINDOW_PAYLOAD = """WITH refs AS (SELECT id, min(h) AS h FROM (SELECT source_id AS id, block_index AS h FROM actions WHERE block_index BETWEEN 1100 AND 1200
      UNION ALL SELECT address_id, block_index FROM debits JOIN actions USING (action_index) WHERE block_index BETWEEN 1100 AND 1200
      UNION ALL SELECT tick_id, block_index FROM debits JOIN actions USING (action_index) WHERE block_index BETWEEN 1100 AND 1200) GROUP BY id)
    SELECT block_index, 'blocks' AS "table", 'data' AS channel, '{"block_index":' || block_index || ',"block_time":' || block_time || ',"ledger_hash":' || coalesce('"' || ledger_hash || '"', 'null')
      || ',"state_hash":' || CASE WHEN block_index = 1200 THEN '"s1200"' ELSE 'null' END || '}' AS row_json FROM blocks WHERE block_index BETWEEN 1100 AND 1200
    UNION ALL SELECT block_index, 'debits', 'data', '{"action_index":' || action_index || ',"address_id":' || address_id || ',"tick_id":' || tick_id || ',"amount":"' || amount || '"}'
      FROM debits JOIN actions USING (action_index) WHERE block_index BETWEEN 1100 AND 1200
    UNION ALL SELECT h, 'index_addresses', 'data', '{"id":' || id || ',"address":"' || address || '"}' FROM index_addresses JOIN refs USING (id)
    UNION ALL SELECT settled_block, 'bets', 'updated', '{"action_index":' || action_index || ',"bet_status_id":' || bet_status_id || ',"settled_block":' || settled_block || '}'
      FROM bets WHERE settled_block BETWEEN 1100 AND 1200"""


@query("window_payload", WINDOW_PAYLOAD, ("blocks", "actions", "debits", "index_addresses", "bets"))
def window_payload(m):
    tables = {"blocks": m.blocks.select("block_index", "block_time", "ledger_hash", F.concat(F.lit("s"), "block_index").alias("state_hash")),
              "actions": m.actions, "debits": m.debits.select("action_index", "address_id", "tick_id", "amount"),
              "index_addresses": m.index_addresses.select("id", "address"), "bets": m.bets}
    rows = ap.window_payload(tables, LOW, HIGH, None, GAS_TICK, m.statuses)
    return rows.where("table <> 'actions'").withColumn("block_index", F.col("block_index").cast("bigint"))


SPLIT, LAST = (2300, 2350), 2404
APPLIED = f"""SELECT 'balances' AS "table", address_id || '|' || tick_id || '|' || {TEXT.format('sum(amount)')} AS row_text FROM ({SIGNED})
      GROUP BY address_id, tick_id HAVING sum(amount) <> 0
    UNION ALL SELECT 'bets', action_index || '|' || bet_status_id || '|' || coalesce(CAST(settled_block AS VARCHAR), '') FROM bets
    UNION ALL SELECT 'blocks', block_index || '|' || block_time || '|' || coalesce(ledger_hash, '') FROM blocks
    UNION ALL SELECT 'debits', action_index || '|' || address_id || '|' || tick_id || '|' || amount FROM debits"""


@query("apply_window", APPLIED, ("credits", "debits", "actions", "blocks", "bets"))
def apply_window(m):
    """The ledger below a height loaded as a version, the rest applied as payloads of two windows, and read back."""
    spark = m.spark
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"
    whole = {"blocks": m.blocks.select("block_index", "block_time", "ledger_hash"), "actions": m.actions, "credits": m.credits, "debits": m.debits, "bets": m.bets}
    early = m.actions.where(F.col("block_index") < SPLIT[0]).select("action_index")
    unsettled = F.coalesce(F.col("settled_block") >= SPLIT[0], F.lit(False))
    base = {"blocks": whole["blocks"].where(F.col("block_index") < SPLIT[0]), "actions": m.actions.where(F.col("block_index") < SPLIT[0]),
            "credits": m.credits.join(early, "action_index", "left_semi"), "debits": m.debits.join(early, "action_index", "left_semi"),
            "bets": m.bets.withColumns({"bet_status_id": F.when(unsettled, F.lit(0)).otherwise(F.col("bet_status_id")).cast("bigint"), "settled_block": F.when(~unsettled, F.col("settled_block"))})}
    base["balances"] = agg.balances(base["credits"], base["debits"])
    versions.write_version(spark, root, base, SPLIT[0] - 1)
    # bets settle up to some way beyond the last block: the second window ends with the last change there is
    ends = m.bets.agg(F.max("settled_block").alias("h")).first()["h"]
    for low, high in ((SPLIT[0], SPLIT[1] - 1), (SPLIT[1], max(LAST, ends or LAST))):
        ap.window_payload(whole, low, high, None, GAS_TICK, m.statuses).write.parquet(f"{root}/payload/{low}")
        rows = spark.read.schema(pipeline.PAYLOAD).parquet(f"{root}/payload/{low}")
        pipeline.stage(spark, root, pipeline.load_tables(spark, root), rows, (low, high)).publish(high)
    now = pipeline.load_tables(spark, root)
    shown = {"balances": ("address_id", "tick_id", "amount"), "bets": ("action_index", "bet_status_id", "settled_block"),
             "blocks": ("block_index", "block_time", "ledger_hash"), "debits": ("action_index", "address_id", "tick_id", "amount")}
    return reduce(DataFrame.unionByName, [now[t].select(F.lit(t).alias("table"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("row_text"))
                                          for t, columns in shown.items()])


UPDATES = """SELECT 'bets' AS "table", CAST(o_custkey AS VARCHAR) AS key, arg_max(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY o_custkey
    UNION ALL SELECT 'index_addresses', CAST(o_custkey AS VARCHAR), arg_min(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT id FROM index_addresses) GROUP BY o_custkey
    UNION ALL SELECT 'index_addresses', CAST(id AS VARCHAR), address FROM index_addresses
    UNION ALL SELECT 'validator_rewards', CAST(k AS VARCHAR), CAST(v AS VARCHAR) FROM (SELECT k, min(h) AS v FROM (SELECT o_custkey AS k, min(o_orderkey) AS h, 0 AS news FROM orders GROUP BY 1
        UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderkey % 2 = 0) r
      LEFT JOIN (SELECT o_custkey AS k, max(o_orderkey) AS until FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) g USING (k)
      WHERE until IS NULL OR (news = 1 AND h > until) GROUP BY k)"""


@query("apply_updates", UPDATES, ("index_addresses",))
def apply_updates(m):
    """Every order is a change of its customer's row at the height of its number: many heights of one key in a batch."""
    orders = m.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").cast("bigint").alias("h"), F.col("o_orderpriority").alias("v"))
    reward = lambda df, height: df.select(F.col("k").alias("source_id"), F.lit(1).alias("signing_pubkey_id"), F.lit("work").alias("reward_type"),
                                          F.lit(None).cast("string").alias("round_reference"), height.alias("block_index"))
    first = orders.groupBy("k").agg(F.min("h").alias("h"))
    tables = {"bets": first.select(F.col("k").alias("action_index"), F.lit("old").alias("value")), "index_addresses": m.index_addresses.select("id", "address"),
              "validator_rewards": reward(first, F.col("h")), "anchor_reward_reconcile_log": reward(orders.where("h % 3 = 0"), F.col("h"))}
    data = {"index_addresses": orders.select(F.col("k").alias("id"), F.col("v").alias("address"), F.col("h").alias(ap.HEIGHT)),
            "validator_rewards": reward(orders.where("h % 2 = 0"), F.col("h")).withColumn(ap.HEIGHT, F.col("block_index"))}
    updated = {"bets": orders.select(F.col("k").alias("action_index"), F.col("v").alias("value"), F.col("h").alias(ap.HEIGHT))}
    now = ap.apply_changes(tables, data, updated, (0, 10**12))
    shown = {"bets": ("action_index", "value"), "index_addresses": ("id", "address"), "validator_rewards": ("source_id", "block_index")}
    return reduce(DataFrame.unionByName, [now[t].select(F.lit(t).alias("table"), F.col(k).cast("string").alias("key"), F.col(v).cast("string").alias("value")) for t, (k, v) in shown.items()])


VERDICTS = """WITH shown AS (SELECT block_index, block_index // 40 AS batch, CASE WHEN block_index % 97 = 0 THEN 'other' ELSE ledger_hash END AS ledger_hash FROM blocks
      WHERE block_index % 211 <> 5 OR block_index <= 2000),
    k AS (SELECT block_index, ledger_hash AS known, true AS held FROM blocks WHERE block_index <= 2000), t AS (SELECT max(block_index) AS tip FROM k),
    b AS (SELECT batch, min(CASE WHEN held AND known IS DISTINCT FROM ledger_hash AND ledger_hash IS NOT NULL THEN block_index END) AS fork_block, any_value(tip) AS tip,
      min(CASE WHEN block_index > tip THEN block_index END) AS low, max(CASE WHEN block_index > tip THEN block_index END) AS high,
      count(DISTINCT CASE WHEN block_index > tip THEN block_index END) AS n FROM shown LEFT JOIN k USING (block_index) CROSS JOIN t GROUP BY batch)
    SELECT batch, CASE WHEN fork_block IS NOT NULL THEN CASE WHEN tip - fork_block + 1 > 100 THEN 'halt: too deep' ELSE 'rollback' END
      WHEN low IS NULL THEN 'skip' WHEN high - tip - n > 0 THEN 'gap' ELSE 'apply' END AS verdict, fork_block, coalesce(high - tip - n, 0) AS n_missing FROM b"""


@query("apply_verdicts", VERDICTS, ("blocks",))
def apply_verdicts(m):
    """Batches of 40 heights, some with another hash or without a block, against a replica that ends at 2000."""
    b = F.col("block_index")
    shown = m.blocks.where((b % 211 != 5) | (b <= 2000)).select(
        b, F.floor(b / 40).cast("bigint").alias("batch"), F.when(b % 97 == 0, "other").otherwise(F.col("ledger_hash")).alias("ledger_hash"))
    return follow.batch_verdicts(shown, m.blocks.where(b <= 2000), ["ledger_hash"], 100)
