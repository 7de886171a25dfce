"""Balance, supply, count, latest-value and mismatch queries."""

from pyspark.sql import functions as F

from blockloom.operators import aggregates as agg
from blockloom.plans.registry import query

SIGNED = """SELECT address_id, tick_id, CAST(amount AS DECIMAL(38,18)) AS amount FROM credits
    UNION ALL SELECT address_id, tick_id, -CAST(amount AS DECIMAL(38,18)) FROM debits"""
TEXT = "rtrim(rtrim(CAST({} AS VARCHAR), '0'), '.')"


@query("ledger_balances", f"""SELECT address_id, tick_id, {TEXT.format('sum(amount)')} AS amount FROM ({SIGNED})
    GROUP BY address_id, tick_id HAVING sum(amount) <> 0""", ("credits", "debits"))
def ledger_balances(m):
    return agg.balances(m.credits, m.debits)


@query("balances_scoped", f"""SELECT address_id, tick_id, {TEXT.format('sum(amount)')} AS amount FROM ({SIGNED})
    GROUP BY address_id, tick_id HAVING sum(amount) <> 0""", ("credits", "debits"))
def balances_scoped(m):
    """Existing balances are the state before height 1200; only keys touched since are rebuilt."""
    before = F.col("action_index") < 1200 * 1_000_000_000
    existing = agg.balances(m.credits.where(before), m.debits.where(before))
    touched = agg.touched_keys([m.credits.where(~before), m.debits.where(~before)], agg.PAIR)
    return agg.balances_scoped(existing, m.credits, m.debits, touched)


@query("net_balance", f"""WITH net AS (SELECT address_id, tick_id, sum(amount) AS n FROM ({SIGNED}) GROUP BY 1, 2)
    SELECT k.address_id, k.tick_id, coalesce({TEXT.format('n')}, '0') AS net
    FROM (SELECT DISTINCT o_custkey AS address_id, o_orderkey % 20 AS tick_id FROM orders) k
    LEFT JOIN net USING (address_id, tick_id)""", ("credits", "debits"))
def net_balance(m):
    wanted = m.table("orders").select(F.col("o_custkey").alias("address_id"), (F.col("o_orderkey") % 20).alias("tick_id"))
    return agg.net_balance(m.credits, m.debits, wanted)


@query("token_supply", """WITH s AS (SELECT tick_id, sum(amount) AS n FROM (
      SELECT tick_id, CAST(amount AS DECIMAL(38,18)) AS amount FROM credits
      UNION ALL SELECT tick_id, -CAST(amount AS DECIMAL(38,18)) FROM debits
      UNION ALL SELECT tick_id, CAST(amount AS DECIMAL(38,18)) FROM escrows) GROUP BY tick_id)
    SELECT t.tick_id, t.decimals, t.escrow_action_index, coalesce(CASE t.decimals
      WHEN 0 THEN CAST(CAST(round(n, 0) AS DECIMAL(38,0)) AS VARCHAR)
      WHEN 1 THEN rtrim(rtrim(CAST(CAST(round(n, 1) AS DECIMAL(38,1)) AS VARCHAR), '0'), '.')
      ELSE rtrim(rtrim(CAST(CAST(round(n, 2) AS DECIMAL(38,2)) AS VARCHAR), '0'), '.') END, '0') AS supply
    FROM tokens t LEFT JOIN s USING (tick_id)""", ("tokens", "credits", "debits", "escrows"))
def token_supply(m):
    return agg.token_supplies(m.tokens, m.credits, m.debits, m.escrows)


@query("table_counts", """SELECT 'credits' AS "table", count(*) AS n_rows FROM credits UNION ALL SELECT 'debits', count(*) FROM debits
    UNION ALL SELECT 'escrows', count(*) FROM escrows UNION ALL SELECT 'actions', count(*) FROM actions
    UNION ALL SELECT 'blocks', count(*) FROM blocks""", ("credits", "debits", "escrows", "actions", "blocks"))
def table_counts(m):
    return agg.table_counts({"credits": m.credits, "debits": m.debits, "escrows": m.escrows,
                             "actions": m.actions, "blocks": m.blocks})


@query("height_bounds", "SELECT min(block_index) AS low, max(block_index) AS high FROM blocks", ("blocks",))
def height_bounds(m):
    return agg.height_bounds(m.orders_base)


@query("touched_keys", """SELECT DISTINCT address_id, tick_id FROM escrow_journal
    UNION SELECT DISTINCT address_id, tick_id FROM debits""", ("escrow_journal", "debits"))
def touched_keys(m):
    return agg.touched_keys([m.escrow_journal, m.debits], agg.PAIR)


@query("latest_state", """SELECT contract_index, state_key, state_value, id FROM contract_state
    WHERE id IN (SELECT max(id) FROM contract_state GROUP BY contract_index, state_key) AND state_value IS NOT NULL""",
       ("contract_state",))
def latest_state(m):
    return agg.latest_per_key(m.contract_state, ["contract_index", "state_key"], "state_value")


@query("state_asof", """SELECT contract_index, state_key, state_value, id FROM contract_state WHERE id IN
    (SELECT max(id) FROM contract_state WHERE block_index <= 500 GROUP BY contract_index, state_key) AND state_value IS NOT NULL""",
       ("contract_state",))
def state_asof(m):
    return agg.latest_per_key(m.contract_state, ["contract_index", "state_key"], "state_value", as_of=500)


@query("locked_asof_many", """SELECT p.address_id, p.tick_id, p.block_index, j.locked_amount FROM
    (SELECT DISTINCT user_id AS address_id, event_id % 20 AS tick_id, (event_id // 10) - (event_id // 10) % 100 + 50 AS block_index FROM events) p
    ASOF LEFT JOIN (SELECT address_id, tick_id, block_index, arg_max(locked_amount_text, id) AS locked_text,
       CASE WHEN arg_max(locked_amount_text, id) = 'NULL' THEN NULL ELSE arg_max(locked_amount_text, id) END AS locked_amount
       FROM (SELECT *, coalesce(locked_amount, 'NULL') AS locked_amount_text FROM escrow_journal) GROUP BY 1, 2, 3) j
    ON p.address_id = j.address_id AND p.tick_id = j.tick_id AND p.block_index >= j.block_index""", ("escrow_journal",))
def locked_asof_many(m):
    height = F.expr("event_id div 10")
    probes = m.table("events").select(
        F.col("user_id").alias("address_id"), (F.col("event_id") % 20).alias("tick_id"),
        (height - height % 100 + 50).alias("block_index")).distinct()
    return agg.as_of_many(m.escrow_journal, probes, agg.PAIR, "locked_amount")


@query("state_in_block", """SELECT block_index, contract_index, state_key, state_value FROM contract_state WHERE id IN
    (SELECT max(id) FROM contract_state GROUP BY block_index, contract_index, state_key)""", ("contract_state",))
def state_in_block(m):
    return agg.latest_in_block(m.contract_state, ["contract_index"], "state_key", "state_value")


@query("state_in_block_folded", """WITH cased AS (SELECT id, block_index, contract_index, state_value,
      CASE WHEN id % 2 = 0 THEN upper(state_key) ELSE state_key END AS state_key FROM contract_state)
    SELECT block_index, contract_index, state_key, state_value FROM cased WHERE id IN
    (SELECT max(id) FROM cased GROUP BY block_index, contract_index, lower(state_key))""", ("contract_state",))
def state_in_block_folded(m):
    cased = m.contract_state.withColumn(
        "state_key", F.when(F.col("id") % 2 == 0, F.upper("state_key")).otherwise(F.col("state_key")))
    return agg.latest_in_block(cased, ["contract_index"], "state_key", "state_value", binary=False)


@query("mismatch_counters", """WITH d AS (SELECT event_type AS "table", props AS name, event_id // 10 AS block_index FROM events),
    r AS (SELECT "table", name, row_number() OVER (PARTITION BY "table" ORDER BY name) AS r FROM (SELECT DISTINCT "table", name FROM d))
    SELECT d."table", count(*) AS n_mismatches, max(block_index) AS last_block, max(n.names) AS names FROM d
    JOIN (SELECT "table", string_agg(name, ',' ORDER BY name) AS names FROM r WHERE r <= 20 GROUP BY 1) n ON n."table" = d."table"
    GROUP BY d."table" """)
def mismatch_counters(m):
    rows = m.table("events").select(F.col("event_type").alias("table"), F.col("props").alias("name"),
                                    F.expr("event_id div 10").alias("block_index"))
    return agg.mismatch_counters(rows, ["table"], "name")
