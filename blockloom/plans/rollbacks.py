"""Rollback step queries and the whole rollback."""

from pyspark.sql import functions as F

from blockloom.operators import rollback as rb
from blockloom.plans.registry import query
from blockloom.plans.replication import OPEN_OFFERS
from blockloom.sources.driver_model import ACTIVATION_DELAY, GAS_TICK

H = 1200
FIRST = H * 1_000_000_000
NET = "rtrim(rtrim(CAST({} AS VARCHAR), '0'), '.')"


@query("rollback_resets", """SELECT 'attests' AS "table", action_index, CASE WHEN hit THEN 'pending' ELSE request_status END AS status, CASE WHEN NOT hit THEN resolved_block END AS stamp
      FROM (SELECT *, coalesce(version = 0 AND request_status IN ('fulfilled', 'errored', 'expired') AND resolved_block >= 600, false) AS hit FROM attests)
    UNION ALL SELECT 'xcalls', action_index, CASE WHEN hit THEN 'pending' ELSE request_status END, CASE WHEN NOT hit THEN callback_action_index END
      FROM (SELECT *, coalesce(version = 0 AND request_status IN ('completed', 'expired') AND resolved_block >= 600, false) AS hit FROM xcalls)
    UNION ALL SELECT 'polls', action_index, CASE WHEN hit THEN 'open' ELSE poll_status END, CASE WHEN NOT hit AND coalesce(callback_due_block, 0) < 600 THEN callback_execute_action_index END
      FROM (SELECT *, coalesce(poll_status IN ('finalized', 'failed_quorum') AND resolved_block >= 600, false) AS hit FROM polls)
    UNION ALL SELECT 'bets', action_index, CASE WHEN hit THEN '4' ELSE CAST(bet_status_id AS VARCHAR) END, CASE WHEN NOT hit THEN settled_block END
      FROM (SELECT *, coalesce(settled_block >= 600, false) AS hit FROM bets)""", ("attests", "xcalls", "polls", "bets"))
def rollback_resets(m):
    frames = [("attests", rb.reset_attests(m.attests, 600), "request_status", "resolved_block"),
              ("xcalls", rb.reset_xcalls(m.xcalls, 600), "request_status", "callback_action_index"),
              ("polls", rb.reset_polls(m.polls, 600), "poll_status", "callback_execute_action_index"),
              ("bets", rb.reset_bets(m.bets, m.statuses, 600), "bet_status_id", "settled_block")]
    out = None
    for t, df, status, stamp in frames:
        part = df.select(F.lit(t).alias("table"), "action_index", F.col(status).cast("string").alias("status"), F.col(stamp).alias("stamp"))
        out = part if out is None else out.unionByName(part)
    return out


@query("rollback_bet_feeds", """WITH a AS (SELECT action_index, CASE WHEN terminal_block >= 600 AND closed_block < 600 THEN 5 WHEN terminal_block >= 600 AND (closed_block IS NULL OR closed_block >= 600) THEN 4 ELSE feed_status_id END AS feed_status_id,
      closed_block, CASE WHEN terminal_block >= 600 THEN NULL ELSE terminal_block END AS terminal_block FROM bet_feeds)
    SELECT action_index, CAST(CASE WHEN closed_block >= 600 THEN 4 ELSE feed_status_id END AS BIGINT) AS feed_status_id, CASE WHEN closed_block >= 600 THEN NULL ELSE closed_block END AS closed_block, terminal_block FROM a""", ("bet_feeds",))
def rollback_bet_feeds(m):
    return rb.reset_bet_feeds(m.bet_feeds, m.statuses, 600)


@query("rollback_restore", """SELECT s.action_index, coalesce((SELECT d.prev_amount FROM slash_debits d WHERE d.stake_action_index = s.action_index AND d.target_table = 'stakes' AND d.block_index >= 600
      ORDER BY d.block_index, d.slash_action_index LIMIT 1), s.amount) AS amount FROM stakes s""", ("stakes", "slash_debits"))
def rollback_restore(m):
    return rb.restore_preimages(m.stakes, "stakes", {"capability_slash_debits": m.slash_debits}, 600).select("action_index", "amount")


@query("earliest_preimage", """SELECT stake_action_index AS action_index, prev_amount FROM (SELECT *, row_number() OVER (PARTITION BY stake_action_index ORDER BY block_index, slash_action_index) AS r
      FROM slash_debits WHERE target_table = 'stakes' AND block_index >= 600) WHERE r = 1""", ("slash_debits",))
def earliest_preimage(m):
    rows = rb.earliest_preimage(m.slash_debits, "stakes", 600, "prev_amount", rb.PREIMAGE_ORDER["capability_slash_debits"])
    return rows.select("action_index", F.col("__restored").alias("prev_amount"))


@query("rollback_renull", """SELECT 'stakes' AS "table", s.action_index, CASE WHEN NOT EXISTS (SELECT 1 FROM unstakes u WHERE u.signing_pubkey_id = s.signing_pubkey_id AND u.block_index >= 1200
      AND s.deactivation_block = u.block_index + 6) THEN s.deactivation_block END AS deactivation_block FROM stakes s
    UNION ALL SELECT 'delegations', p.action_index, CASE WHEN NOT EXISTS (SELECT 1 FROM delegations r WHERE r.source_id = p.source_id AND r.signing_pubkey_id = p.signing_pubkey_id
      AND r.block_index >= 500 AND p.deactivation_block = r.block_index + 500) THEN p.deactivation_block END FROM delegations p""", ("stakes", "unstakes", "delegations"))
def rollback_renull(m):
    stakes = rb.clear_stamps(m.stakes, m.unstakes, ["signing_pubkey_id"], H, ACTIVATION_DELAY)
    lent = rb.clear_stamps(m.delegations, m.delegations, ["source_id", "signing_pubkey_id"], 500, 500)
    cols = ["table", "action_index", "deactivation_block"]
    return stakes.withColumn("table", F.lit("stakes")).select(*cols).unionByName(
        lent.withColumn("table", F.lit("delegations")).select(*cols))


@query("rollback_rewards", """WITH lost AS (SELECT source_id, signing_pubkey_id, reward_type, round_reference, amount, reward_block_index AS block_index, reward_derive_block_index AS derive_block_index FROM reconcile_log
      WHERE block_index >= 1200 AND reward_block_index < 1200 AND (reward_derive_block_index IS NULL OR reward_derive_block_index < 1200)),
    kept AS (SELECT * FROM rewards WHERE source_id % 10 <> 3)
    SELECT * FROM kept UNION ALL SELECT * FROM lost WHERE round_reference IS NULL
    UNION ALL SELECT source_id, signing_pubkey_id, reward_type, round_reference, p.amount, p.block_index, p.derive_block_index FROM (
      SELECT source_id, signing_pubkey_id, reward_type, round_reference, min({'amount': amount, 'block_index': block_index, 'derive_block_index': coalesce(derive_block_index, -1)}) AS q, arg_min({'amount': amount, 'block_index': block_index, 'derive_block_index': derive_block_index}, {'amount': amount, 'block_index': block_index, 'derive_block_index': coalesce(derive_block_index, -1)}) AS p
      FROM lost l WHERE round_reference IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.source_id = l.source_id AND k.signing_pubkey_id = l.signing_pubkey_id AND k.reward_type = l.reward_type AND k.round_reference = l.round_reference)
      GROUP BY 1, 2, 3, 4)""", ("rewards", "reconcile_log"))
def rollback_rewards(m):
    return rb.restore_rewards(m.rewards.where("source_id % 10 <> 3"), m.reconcile_log, H)


@query("rollback_archive", """SELECT p.action_index, CASE WHEN p.version IN (1, 6) AND p.status_id = 9 AND p.block_index < 1200 AND EXISTS (SELECT 1 FROM anchors c WHERE c.version = 2 AND c.status_id = 1
      AND c.match_batch_seq = p.match_batch_seq AND c.action_index >= (SELECT min(action_index) FROM actions WHERE block_index >= 1200)) THEN 10 ELSE p.status_id END AS status_id FROM anchors p""", ("anchors", "actions"))
def rollback_archive(m):
    return rb.reset_archive_heads(m.anchors, m.statuses, FIRST).select("action_index", "status_id")


REFUNDED = """refunded AS (SELECT c.action_index, c.address_id, c.tick_id FROM credits c JOIN unstakes u ON u.action_index = c.action_index AND u.source_id = c.address_id
      JOIN index_tickers g ON g.id = c.tick_id AND g.tick = 'TICK0' WHERE u.status_id = 3 AND u.cooldown_end_block >= 1200 AND u.block_index < 1200
    UNION SELECT c.action_index, c.address_id, c.tick_id FROM credits c JOIN contract_unstakes u ON u.action_index = c.action_index AND u.source_id = c.address_id AND u.tick_id = c.tick_id
      WHERE u.status_id = 3 AND u.cooldown_end_block >= 1200 AND u.block_index < 1200),
    kept AS (SELECT c.* FROM credits c WHERE c.action_index < 1200000000000 AND NOT EXISTS (SELECT 1 FROM refunded r WHERE r.action_index = c.action_index AND r.address_id = c.address_id AND r.tick_id = c.tick_id))"""
LEDGER = ("credits", "debits", "escrows", "unstakes", "contract_unstakes", "index_tickers")


def rolled_back(m):
    tables = {"actions": m.actions, "credits": m.credits, "debits": m.debits, "escrows": m.escrows, "blocks": m.blocks,
              "transactions": m.transactions, "unstakes": m.unstakes, "contract_unstakes": m.contract_unstakes,
              "index_addresses": m.index_addresses, "index_tickers": m.index_tickers, "index_statuses": m.statuses,
              "balances": m.credits.select("address_id", "tick_id", "amount")}
    return rb.rollback_indexer(tables, H, "BTC", ACTIVATION_DELAY, GAS_TICK)


@query("rollback_ledger", f"""WITH {REFUNDED} SELECT 'credits' AS "table", * FROM kept UNION ALL SELECT 'debits', * FROM debits WHERE action_index < 1200000000000
    UNION ALL SELECT 'escrows', * FROM escrows WHERE action_index < 1200000000000""", LEDGER)
def rollback_ledger(m):
    new = rolled_back(m)
    out = None
    for t in ("credits", "debits", "escrows"):
        part = new[t].withColumn("table", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out


@query("rollback_balances", f"""WITH {REFUNDED} SELECT address_id, tick_id, {NET.format('sum(a)')} AS amount FROM (
      SELECT address_id, tick_id, CAST(amount AS DECIMAL(38,18)) AS a FROM kept UNION ALL SELECT address_id, tick_id, -CAST(amount AS DECIMAL(38,18)) FROM debits WHERE action_index < 1200000000000)
    GROUP BY 1, 2 HAVING sum(a) <> 0""", LEDGER)
def rollback_balances(m):
    return rolled_back(m)["balances"]


@query("rollback_cooldowns", """SELECT 'unstakes' AS "table", action_index, CASE WHEN status_id = 3 AND cooldown_end_block >= 1200 THEN 1 ELSE status_id END AS status_id FROM unstakes WHERE block_index < 1200
    UNION ALL SELECT 'contract_unstakes', action_index, CASE WHEN status_id = 3 AND cooldown_end_block >= 1200 THEN 1 ELSE status_id END FROM contract_unstakes WHERE block_index < 1200""", ("unstakes", "contract_unstakes"))
def rollback_cooldowns(m):
    new = rolled_back(m)
    cols = ["table", "action_index", "status_id"]
    return new["unstakes"].withColumn("table", F.lit("unstakes")).select(*cols).unionByName(
        new["contract_unstakes"].withColumn("table", F.lit("contract_unstakes")).select(*cols))


@query("rollback_lookups", """SELECT 'blocks' AS "table", count(*) AS n_rows FROM blocks WHERE block_index < 1200 UNION ALL SELECT 'transactions', count(*) FROM transactions WHERE block_index < 1200
    UNION ALL SELECT 'index_addresses', count(*) FROM index_addresses WHERE block_index IS NULL OR block_index < 1200
    UNION ALL SELECT 'index_tickers', count(*) FROM index_tickers WHERE block_index IS NULL OR block_index < 1200""", ("blocks", "transactions", "index_addresses", "index_tickers"))
def rollback_lookups(m):
    from blockloom.operators.aggregates import table_counts
    new = rolled_back(m)
    return table_counts({t: new[t] for t in ("blocks", "transactions", "index_addresses", "index_tickers")})


@query("rollback_orphans", """SELECT o_custkey, o_orderkey FROM orders o WHERE NOT (o_custkey NOT IN (SELECT id FROM index_addresses WHERE block_index IS NULL OR block_index < 1200))""", ("index_addresses",))
def rollback_orphans(m):
    left = rb.below(m.index_addresses, "block_index", H)
    return rb.keep_referenced(m.table("orders").select("o_custkey", "o_orderkey"), "o_custkey", left)


@query("rollback_markets", """WITH t AS (SELECT action_index, least(give_tick_id, get_tick_id) AS a, greatest(give_tick_id, get_tick_id) AS b FROM offers WHERE kind < 2),
    f AS (SELECT a, b FROM t GROUP BY 1, 2 HAVING bool_or(action_index >= 2250000000000) AND NOT bool_or(action_index < 2250000000000)),
    mk AS (SELECT DISTINCT give_tick_id AS tick1_id, get_tick_id AS tick2_id FROM offers)
    SELECT * FROM mk WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.a = least(tick1_id, tick2_id) AND f.b = greatest(tick1_id, tick2_id))""", ("offers",))
def rollback_markets(m):
    markets = None
    for kind in range(3):
        part = m.offers(kind).select(F.col("give_tick_id").alias("tick1_id"), F.col("get_tick_id").alias("tick2_id"))
        markets = part if markets is None else markets.unionByName(part)
    return rb.drop_dead_markets(markets.distinct(), m.offers(0), m.offers(1), 2250 * 1_000_000_000)


@query("rollback_gate", f"""WITH kept_offers AS (SELECT * FROM offers WHERE action_index < 1200000000000), kept_statuses AS (SELECT * FROM offer_statuses WHERE action_index < 1200000000000),
    {OPEN_OFFERS.replace('offer_statuses', 'kept_statuses').replace('FROM offers f', 'FROM kept_offers f')}
    SELECT t.tick_id, (SELECT min(action_index) FROM o WHERE o.give_tick_id = t.tick_id) AS escrow_action_index FROM tokens t""", ("offers", "offer_statuses", "statuses", "tokens"))
def rollback_gate(m):
    from blockloom.operators.apply import rederive_escrow_gate
    families = [(rb.below(m.offers(k), "action_index", FIRST), rb.below(m.offer_statuses(k), "action_index", FIRST)) for k in range(3)]
    return rederive_escrow_gate(m.tokens, families, m.statuses, m.index_tickers).select("tick_id", "escrow_action_index")


@query("rollback_emissions", """SELECT b.action_index AS execution_index, b.l_linenumber AS position FROM ledger_base b WHERE NOT EXISTS
      (SELECT 1 FROM actions a WHERE a.action_index = b.action_index AND a.action = '1-URGENT' AND a.block_index >= 1200)""", ("ledger_base", "actions"))
def rollback_emissions(m):
    emissions = m.ledger_base.select(F.col("action_index").alias("execution_index"), F.col("l_linenumber").alias("position"))
    return rb.cascade_emissions(emissions, m.actions.where("action = '1-URGENT'"), FIRST)


@query("rollback_decoder", """SELECT 'outputs' AS "table", l_orderkey AS tx_index, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT tx_index FROM transactions WHERE block_index >= 1200)
    UNION ALL SELECT 'transactions', tx_index, block_index FROM transactions WHERE block_index < 1200""", ("transactions",))
def rollback_decoder(m):
    outputs = m.table("lineitem").select(F.col("l_orderkey").alias("tx_index"), F.col("l_linenumber").cast("bigint").alias("n"))
    new = rb.rollback_decoder({"transactions": m.transactions, "transaction_outputs": outputs, "blocks": m.blocks}, H)
    kept = new["transactions"].select(F.lit("transactions").alias("table"), "tx_index", F.col("block_index").alias("n"))
    return new["transaction_outputs"].select(F.lit("outputs").alias("table"), "tx_index", "n").unionByName(kept)
