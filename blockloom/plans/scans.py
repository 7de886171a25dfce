"""Scan, paging, predicate, set and lookup queries."""

from pyspark.sql import functions as F

from blockloom.functions import canon, gates
from blockloom.operators import scan
from blockloom.plans.registry import query

LOW, HIGH = 600, 1400


@query("block_scan", "SELECT * FROM blocks WHERE block_index BETWEEN 600 AND 1400", ("blocks",))
def block_scan(m):
    return scan.block_scan(m.blocks, LOW, HIGH)


@query("action_scan", """SELECT c.* FROM credits c JOIN actions a ON a.action_index = c.action_index
    WHERE a.block_index BETWEEN 600 AND 1400""", ("credits", "actions"))
def action_scan(m):
    return scan.action_scan(m.credits, m.actions, LOW, HIGH)


@query("tx_scan", """SELECT o.o_orderkey AS tx_index, o.o_totalprice AS fee FROM orders o JOIN transactions t
    ON t.tx_index = o.o_orderkey WHERE t.block_index BETWEEN 600 AND 1400""", ("transactions",))
def tx_scan(m):
    outputs = m.table("orders").select(F.col("o_orderkey").alias("tx_index"), F.col("o_totalprice").alias("fee"))
    return scan.tx_scan(outputs, m.transactions, LOW, HIGH)


@query("two_hop_scan", """SELECT b.action_index AS execution_index, b.l_returnflag AS emitted_action,
    CASE WHEN b.l_linenumber % 2 = 0 THEN b.action_index + b.l_linenumber END AS action_index, b.l_linenumber AS position
    FROM ledger_base b JOIN actions a ON a.action_index = b.action_index
    WHERE a.action = '1-URGENT' AND a.block_index BETWEEN 600 AND 1400""", ("ledger_base", "actions"))
def two_hop_scan(m):
    child = F.when(F.col("l_linenumber") % 2 == 0, F.col("action_index") + F.col("l_linenumber"))
    emissions = m.ledger_base.select(
        F.col("action_index").alias("execution_index"), F.col("l_returnflag").alias("emitted_action"),
        child.alias("action_index"), F.col("l_linenumber").alias("position"))
    executions = m.actions.where("action = '1-URGENT'").select("action_index")
    return scan.emission_scan(emissions, executions, m.actions, LOW, HIGH)


@query("nonempty_tables", """SELECT * FROM (
    SELECT 'credits' AS "table", count(*) AS n_rows FROM credits c JOIN actions a USING (action_index) WHERE a.block_index BETWEEN 600 AND 1400
    UNION ALL SELECT 'debits', count(*) FROM debits c JOIN actions a USING (action_index) WHERE a.block_index BETWEEN 600 AND 1400
    UNION ALL SELECT 'escrows', count(*) FROM escrows c JOIN actions a USING (action_index) WHERE a.block_index BETWEEN 600 AND 1400
    UNION ALL SELECT 'stakes', count(*) FROM stakes c JOIN actions a USING (action_index) WHERE a.block_index BETWEEN 600 AND 1400
    ) WHERE n_rows > 0""", ("credits", "debits", "escrows", "stakes", "actions"))
def nonempty_tables(m):
    tables = {"credits": m.credits, "debits": m.debits, "escrows": m.escrows, "stakes": m.stakes}
    return scan.nonempty_tables(tables, m.actions, LOW, HIGH)


@query("id_page", """WITH page AS (SELECT s_suppkey AS id, s_name AS address FROM supplier WHERE s_suppkey > 20 ORDER BY s_suppkey LIMIT 50)
    SELECT id, address, max(id) OVER () AS max_id, count(*) OVER () = 50 AS has_more FROM page""")
def id_page(m):
    return scan.id_page(m.index_addresses.select("id", "address"), after=20, limit=50)


@query("keyset_page", """SELECT block_index, tx_index FROM transactions
    WHERE block_index > 700 OR (block_index = 700 AND tx_index > 500) ORDER BY block_index, tx_index LIMIT 100""", ("transactions",))
def keyset_page(m):
    return scan.keyset_page(m.transactions.select("block_index", "tx_index"), ["block_index", "tx_index"], [700, 500], 100)


@query("first_action", "SELECT min(action_index) AS first_action_index FROM actions WHERE block_index >= 1200", ("actions",))
def first_action(m):
    return scan.first_action(m.actions, 1200)


@query("ref_lookups", """WITH ids AS (SELECT address_id AS id FROM credits UNION SELECT tick_id FROM credits
    UNION SELECT address_id FROM debits UNION SELECT tick_id FROM debits)
    SELECT 'index_addresses' AS "table", id, address AS text FROM index_addresses WHERE id IN (SELECT id FROM ids)
    UNION ALL SELECT 'index_tickers', id, tick FROM index_tickers WHERE id IN (SELECT id FROM ids)""",
       ("credits", "debits", "index_addresses", "index_tickers"))
def ref_lookups(m):
    found = scan.referenced_lookups([m.credits, m.debits],
                                    {"index_addresses": m.index_addresses, "index_tickers": m.index_tickers})
    parts = [found[t].select(F.lit(t).alias("table"), "id", F.col(c).alias("text"))
             for t, c in (("index_addresses", "address"), ("index_tickers", "tick"))]
    return parts[0].unionByName(parts[1])


@query("infra_filter", """SELECT event_type AS "table", count(*) AS n_rows FROM events
    WHERE event_type IN ('view', 'purchase') GROUP BY event_type""")
def infra_filter(m):
    changes = m.table("events").withColumnRenamed("event_type", "table")
    return scan.project_tables(changes, ["view", "purchase"]).groupBy("table").agg(F.count("*").alias("n_rows"))


@query("exclude_filter", """SELECT event_type AS "table", count(*) AS n_rows FROM events
    WHERE event_type NOT IN ('view', 'purchase') GROUP BY event_type""")
def exclude_filter(m):
    changes = m.table("events").withColumnRenamed("event_type", "table")
    return scan.exclude_tables(changes, ["view", "purchase"]).groupBy("table").agg(F.count("*").alias("n_rows"))


@query("role_canon", """SELECT c.action_index, coalesce(r.role, i.address) AS address, c.amount
    FROM credits c LEFT JOIN index_addresses i ON i.id = c.address_id
    LEFT JOIN (SELECT n_name, 'ROLE_' || n_nationkey AS role, 'Supplier#' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0') AS address FROM nation) r
    ON r.address = i.address""", ("credits", "index_addresses"))
def role_canon(m):
    key = F.col("n_nationkey").cast("string")
    roles = m.table("nation").select(
        F.concat(F.lit("Supplier#"), F.lpad(key, 9, "0")).alias("address"), F.concat(F.lit("ROLE_"), key).alias("role"))
    named = scan.resolve(m.credits, m.index_addresses, "address_id", "address", "address")
    return scan.canonical_role_by_table(named.select("action_index", "address", "amount"), roles, "address")


@query("height_gate", """SELECT block_index, coin, network,
    CASE coin || ':' || network WHEN 'BTC:mainnet' THEN block_index + 957000 >= 958500
         WHEN 'LTC:testnet' THEN block_index + 957000 >= 4805000
         ELSE CASE WHEN network = 'regtest' THEN true ELSE false END END AS active
    FROM (SELECT block_index, CASE block_index % 3 WHEN 0 THEN 'BTC' WHEN 1 THEN 'LTC' ELSE 'NEW' END AS coin,
          CASE block_index % 3 WHEN 0 THEN 'mainnet' WHEN 1 THEN 'testnet'
               ELSE CASE WHEN block_index % 2 = 0 THEN 'regtest' ELSE 'simnet' END END AS network FROM blocks)""", ("blocks",))
def height_gate(m):
    b = F.col("block_index")
    scoped = m.blocks.select(
        "block_index", F.when(b % 3 == 0, "BTC").when(b % 3 == 1, "LTC").otherwise("NEW").alias("coin"),
        F.when(b % 3 == 0, "mainnet").when(b % 3 == 1, "testnet")
         .when(b % 2 == 0, "regtest").otherwise("simnet").alias("network"))
    shifted = scoped.withColumn("height", b + 957000)
    gated = gates.with_gate(shifted, gates.activation_rows(m.spark), "token_supply_hash", "active", block="height")
    return gated.select("block_index", "coin", "network", "active")


@query("log_page", """SELECT block_index, block_time, ledger_hash, (SELECT count(*) FROM blocks) AS total
    FROM blocks ORDER BY block_index DESC LIMIT 100 OFFSET 200""", ("blocks",))
def log_page(m):
    return scan.log_page(m.blocks, 2, 100, ["block_index", "block_time", "ledger_hash"])


@query("event_quarantine", """SELECT event_id, kind, height, CASE
    WHEN kind NOT IN ('block', 'reorg', 'status') THEN 'unknown type'
    WHEN kind IN ('block', 'reorg') AND height < 0 THEN 'block_index must be a whole number >= 0' END AS reason
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'block' WHEN 'click' THEN 'block' WHEN 'purchase' THEN 'reorg'
          WHEN 'signup' THEN 'status' ELSE event_type END AS kind,
          CAST(regexp_extract(props, '[0-9]+') AS BIGINT) - 5 AS height FROM events)""")
def event_quarantine(m):
    t = F.col("event_type")
    kind = F.when(t.isin("view", "click"), "block").when(t == "purchase", "reorg").when(t == "signup", "status").otherwise(t)
    rows = m.table("events").select(
        "event_id", kind.alias("kind"), (F.get_json_object("props", "$.k").cast("bigint") - 5).alias("height"))
    return rows.withColumn("reason", scan.event_reason(F.col("kind"), F.col("height"), F.col("height")))


@query("offset_window", """SELECT action_index, deactivation_block FROM stakes
    WHERE deactivation_block BETWEEN 1100 + 6 AND 1300 + 6""", ("stakes",))
def offset_window(m):
    return m.stakes.where(scan.in_window("deactivation_block", 1100, 1300, offset=6)).select(
        "action_index", "deactivation_block")


@query("null_scope", "SELECT id, address FROM index_addresses WHERE block_index IS NOT NULL AND block_index <= 1200", ("index_addresses",))
def null_scope(m):
    return m.index_addresses.where("block_index is not null and block_index <= 1200").select("id", "address")


@query("side_channel_merge", """SELECT * FROM credits UNION ALL
    SELECT action_index, address_id, tick_id, max(amount) FROM debits d WHERE NOT EXISTS (
      SELECT 1 FROM credits c WHERE c.action_index = d.action_index AND c.address_id = d.address_id AND c.tick_id = d.tick_id)
    GROUP BY action_index, address_id, tick_id
    UNION ALL SELECT o.action_index, o.o_custkey, o.o_orderkey % 20, '1' FROM orders_base o WHERE NOT EXISTS (
      SELECT 1 FROM credits c WHERE c.action_index = o.action_index AND c.address_id = o.o_custkey AND c.tick_id = o.o_orderkey % 20)""",
       ("credits", "debits", "orders_base"))
def side_channel_merge(m):
    identity = ["action_index", "address_id", "tick_id"]
    extra = m.debits.groupBy(*identity).agg(F.max("amount").alias("amount"))
    minted = m.orders_base.select("action_index", F.col("o_custkey").alias("address_id"),
                                  (F.col("o_orderkey") % 20).alias("tick_id"), F.lit("1").alias("amount"))
    return scan.merge_side_channel(m.credits, extra.unionByName(minted), identity)


@query("skip_applied", """SELECT block_index, block_time FROM blocks WHERE block_index NOT IN
    (SELECT o_custkey FROM orders)""", ("blocks",))
def skip_applied(m):
    applied = m.table("orders").select(F.col("o_custkey").alias("block_index"))
    return scan.skip_applied(m.blocks.select("block_index", "block_time"), applied)


@query("resolved_ledger", """SELECT c.action_index, i.address, t.tick, c.amount FROM credits c
    LEFT JOIN index_addresses i ON i.id = c.address_id LEFT JOIN index_tickers t ON t.id = c.tick_id""",
       ("credits", "index_addresses", "index_tickers"))
def resolved_ledger(m):
    named = scan.resolve(m.credits, m.index_addresses, "address_id", "address", "address")
    return scan.resolve(named, m.index_tickers, "tick_id", "tick", "tick").select("action_index", "address", "tick", "amount")


@query("predecessor_hash", """SELECT b.block_index, p.block_index IS NOT NULL AS has_predecessor, p.ledger_hash AS previous_hash
    FROM blocks b LEFT JOIN blocks p ON p.block_index = b.block_index - 1""", ("blocks",))
def predecessor_hash(m):
    prior = m.blocks.select((F.col("block_index") + 1).alias("block_index"), F.lit(True).alias("seen"),
                            F.col("ledger_hash").alias("previous_hash"))
    return m.blocks.select("block_index").join(prior, "block_index", "left").select(
        "block_index", F.coalesce("seen", F.lit(False)).alias("has_predecessor"), "previous_hash")


@query("canonical_amounts", """SELECT action_index, address_id, tick_id,
    CAST(CAST(amount AS DECIMAL(38,18)) AS VARCHAR) AS amount FROM credits""", ("credits",))
def canonical_amounts(m):
    from blockloom.functions.decimals import canonical_amount
    return m.credits.withColumn("amount", canonical_amount(F.col("amount")))


@query("smt_leaves", """SELECT sha256('XCHAIN_BAL' || chr(0) || 'BTC' || chr(0) || 'regtest' || chr(0) || address || chr(0) || tick) AS key,
    sha256(chr(0) || CAST(net AS VARCHAR)) AS leaf FROM (
    SELECT i.address, t.tick, sum(s.amount) AS net FROM (
      SELECT address_id, tick_id, CAST(amount AS DECIMAL(38,18)) AS amount FROM credits
      UNION ALL SELECT address_id, tick_id, -CAST(amount AS DECIMAL(38,18)) FROM debits) s
    JOIN index_addresses i ON i.id = s.address_id JOIN index_tickers t ON t.id = s.tick_id
    GROUP BY i.address, t.tick HAVING sum(s.amount) <> 0)""", ("credits", "debits", "index_addresses", "index_tickers"))
def smt_leaves(m):
    from blockloom.operators.smt import balance_leaves
    return balance_leaves(m.credits, m.debits, m.index_addresses, m.index_tickers, "BTC", "regtest")


@query("lag_report", """SELECT user_id, CASE WHEN max(event_id) IS NOT NULL AND NOT max(event_id) % 5 = 0
    THEN greatest(0, (SELECT max(event_id) // 10 FROM events) - max(event_id) // 10) END AS lag_blocks
    FROM events GROUP BY user_id""")
def lag_report(m):
    seen = m.table("events").groupBy("user_id").agg(F.max("event_id").alias("last"))
    tip = m.table("events").agg(F.expr("max(event_id) div 10")).scalar()
    return seen.withColumn("tip", tip).select("user_id", canon.lag_blocks(
        F.col("tip"), F.expr("last div 10"), F.col("last") % 5 == 0).alias("lag_blocks"))
