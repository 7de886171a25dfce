"""Epoch log, Merkle and state-commitment queries."""

import uuid

from pyspark.sql import functions as F

from blockloom.functions import canon
from blockloom.operators import epochs as ep
from blockloom.operators import aggregates as agg
from blockloom.operators import integrity, merkle, smt, smt_store, verify
from blockloom.plans.integrity import block_tables, execution_tables, jtext, tail
from blockloom.plans.registry import query
from blockloom.session import ensure_checkpoint_dir, materialise

LOG = """logged AS (SELECT block_index, ledger_hash, actions_hash, contract_hash FROM blocks WHERE block_index % 17 <> 5),
    leaves AS (SELECT (block_index + 99) // 100 AS epoch, block_index, sha256(coalesce(ledger_hash, '') || coalesce(actions_hash, '') || coalesce(contract_hash, '')) AS leaf
      FROM logged WHERE block_index >= 1)"""


def log(m):
    return m.blocks.where("block_index % 17 <> 5").select("block_index", "ledger_hash", "actions_hash", "contract_hash")


def fold_sql(levels: int = 7) -> str:
    """Level-by-level pairing of hex texts; the last of an odd level pairs with itself."""
    steps = ["v0 AS (SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY block_index) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY epoch) AS n FROM leaves)"]
    for k in range(1, levels + 1):
        steps.append(f"""v{k} AS (SELECT epoch, i // 2 AS i, CASE WHEN min(n) = 1 THEN min(h) ELSE sha256(min(CASE WHEN i % 2 = 0 THEN h END) || coalesce(min(CASE WHEN i % 2 = 1 THEN h END), min(h))) END AS h,
          (min(n) + 1) // 2 AS n FROM v{k - 1} GROUP BY epoch, i // 2)""")
    return ", ".join(steps)


ROOTS = f"""{LOG}, {fold_sql()}, roots AS (SELECT l.epoch, min(l.block_index) AS start_block, max(l.block_index) AS end_block, min(v.h) AS merkle_root, count(*) AS leaf_count
      FROM leaves l JOIN v7 v ON v.epoch = l.epoch WHERE l.epoch * 100 <= (SELECT max(block_index) FROM logged) GROUP BY l.epoch)"""


@query("epoch_leaves", f"WITH {LOG} SELECT * FROM leaves", ("blocks",))
def epoch_leaves(m):
    return ep.leaves(log(m))


@query("epoch_roots", f"WITH {ROOTS} SELECT * FROM roots", ("blocks",))
def epoch_roots(m):
    return ep.roots(log(m))


@query("epoch_proofs", f"""WITH {ROOTS} SELECT l.epoch, l.block_index, r.merkle_root, row_number() OVER (PARTITION BY l.epoch ORDER BY l.block_index) - 1 AS position, r.epoch IS NOT NULL AS verified,
      CASE WHEN r.epoch IS NULL THEN 'epoch not yet committed' END AS error FROM leaves l LEFT JOIN roots r ON r.epoch = l.epoch""", ("blocks",))
def epoch_proofs(m):
    rows = ep.proofs(log(m), ep.roots(log(m)))
    return rows.select("epoch", "block_index", "merkle_root", F.col("position").cast("bigint").alias("position"), "verified", "error")


@query("epoch_gaps", f"""WITH {LOG} SELECT block_index FROM blocks WHERE block_index > (SELECT min(block_index) FROM logged) AND block_index < (SELECT max(block_index) FROM logged)
    AND block_index NOT IN (SELECT block_index FROM logged)""", ("blocks",))
def epoch_gaps(m):
    return ep.gaps(log(m), m.blocks)


@query("epoch_backfill", ROOTS.replace("logged AS (SELECT block_index, ledger_hash, actions_hash, contract_hash FROM blocks WHERE block_index % 17 <> 5)",
       """old AS (SELECT * FROM blocks WHERE block_index % 17 <> 5), logged AS (SELECT block_index, ledger_hash, actions_hash, contract_hash FROM blocks
          WHERE block_index % 17 <> 5 OR (block_index > (SELECT min(block_index) FROM old) AND block_index < (SELECT max(block_index) FROM old)))""").join(["WITH ", " SELECT * FROM roots"]), ("blocks",))
def epoch_backfill(m):
    source = m.blocks.select("block_index", "ledger_hash", "actions_hash", "contract_hash")
    _, rebuilt = ep.backfill(log(m), ep.roots(log(m)), source)
    return rebuilt


@query("epoch_prune", f"""WITH {ROOTS} SELECT CAST(1234 AS BIGINT) AS reorg_block, epoch, start_block, end_block, merkle_root AS old_root, CAST(NULL AS VARCHAR) AS new_root FROM roots WHERE end_block >= 1234 AND epoch % 5 <> 0
    UNION ALL SELECT 7, epoch, start_block, end_block, 'older', NULL FROM roots WHERE epoch % 5 = 0""", ("blocks",))
def epoch_prune(m):
    known = ep.roots(log(m))
    markers = known.where("epoch % 5 = 0").select(F.lit(7).cast("bigint").alias("reorg_block"), "epoch", "start_block", "end_block",
                                                  F.lit("older").alias("old_root"), F.lit(None).cast("string").alias("new_root"))
    return ep.prune_from(log(m), known, markers, 1234)[2]


@query("epoch_retention", f"""WITH {ROOTS} SELECT block_index FROM logged WHERE block_index > (SELECT max(end_block) FROM roots WHERE end_block <= (SELECT max(block_index) FROM logged) - 500)""", ("blocks",))
def epoch_retention(m):
    return ep.retain(log(m), ep.roots(log(m)), 500).select("block_index")


@query("latest_epoch", f"WITH {ROOTS} SELECT * FROM roots ORDER BY epoch DESC LIMIT 1", ("blocks",))
def latest_epoch(m):
    return ep.latest_root(ep.roots(log(m)))


@query("checkpoint_range", """SELECT block_index, checkpoint_seq, status FROM (SELECT *, row_number() OVER (PARTITION BY block_index ORDER BY checkpoint_seq DESC) AS r
      FROM (SELECT block_index, o_orderkey AS checkpoint_seq, o_orderstatus AS status FROM orders_base WHERE block_index BETWEEN 300 AND 900)) WHERE r = 1 ORDER BY block_index LIMIT 200""", ("orders_base",))
def checkpoint_range(m):
    rows = m.orders_base.select("block_index", F.col("o_orderkey").alias("checkpoint_seq"), F.col("o_orderstatus").alias("status"))
    return ep.latest_per_height(rows, 300, 900, 200)


# ---- block content trees -------------------------------------------------------------------------
def nul(*fields: str) -> str:
    return "|| chr(0) ||".join(f"coalesce(CAST({f} AS VARCHAR), '')" for f in fields)


def leaf_sql(*fields: str) -> str:
    return f"sha256(chr(0) || {nul(*fields)})"


def ledger_leaves_sql() -> str:
    parts = []
    for rank, (table, kind) in enumerate((("credits", "credit"), ("debits", "debit"), ("escrows", "escrow"))):
        leaf = leaf_sql("'L'", f"'{kind}'", "x.action_index", "i.address", "k.tick", "x.amount")
        parts.append(f"""SELECT a.block_index, {rank} AS rank, x.action_index AS n1, i.address AS s1, k.tick AS s2, x.amount AS s3, {leaf} AS leaf FROM {table} x JOIN actions a ON a.action_index = x.action_index
          LEFT JOIN index_addresses i ON i.id = x.address_id LEFT JOIN index_tickers k ON k.id = x.tick_id""")
    parts.append(f"SELECT block_index, 3, action_index, NULL, NULL, NULL, {leaf_sql(chr(39) + 'A' + chr(39), 'action_index', 'tx_index', 'action')} FROM actions")
    return " UNION ALL ".join(parts)


def ledger_only(m):
    return {k: v for k, v in block_tables(m).items() if not k.startswith("contract")}


@query("block_leaf_positions", f"""SELECT block_index, leaf, row_number() OVER (PARTITION BY block_index ORDER BY rank, n1, s1, s2, s3, leaf) - 1 AS position FROM ({ledger_leaves_sql()})""",
       ("credits", "debits", "escrows", "actions", "index_addresses", "index_tickers"))
def block_leaf_positions(m):
    return merkle.block_positions(merkle.block_leaves(ledger_only(m), late=True))


def node_sql(levels: int = 12) -> str:
    """Fixed binary tree by level; an absent right sibling is the empty subtree of that height."""
    steps = [f"""w0 AS (SELECT block_index, row_number() OVER (PARTITION BY block_index ORDER BY rank, n1, s1, s2, s3, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY block_index) AS n FROM ({ledger_leaves_sql()}))"""]
    for k in range(1, levels + 1):
        empty = canon.EMPTY_ROOTS[k - 1].hex()
        joined = f"sha256(unhex('01') || unhex(min(CASE WHEN i % 2 = 0 THEN h END)) || unhex(coalesce(min(CASE WHEN i % 2 = 1 THEN h END), '{empty}')))"
        steps.append(f"""w{k} AS (SELECT block_index, i // 2 AS i, CASE WHEN min(n) = 1 THEN min(h) ELSE {joined} END AS h, (min(n) + 1) // 2 AS n FROM w{k - 1} GROUP BY block_index, i // 2)""")
    return ", ".join(steps)


@query("block_merkle_root", f"""WITH {node_sql()} SELECT b.block_index, w12.h AS block_merkle_root, c.n AS leaf_count FROM blocks b JOIN w12 ON w12.block_index = b.block_index
      JOIN (SELECT block_index, max(n) AS n FROM w0 GROUP BY 1) c ON c.block_index = b.block_index""", ("credits", "debits", "escrows", "actions", "index_addresses", "index_tickers", "blocks"))
def block_merkle_root(m):
    return merkle.block_merkle_roots(ledger_only(m), m.blocks)


@query("block_merkle_proofs", f"""WITH {node_sql()} SELECT w0.block_index, w0.i AS position, w12.h AS root, true AS verified FROM w0 JOIN w12 ON w12.block_index = w0.block_index""",
       ("credits", "debits", "escrows", "actions", "index_addresses", "index_tickers"))
def block_merkle_proofs(m):
    proofs = merkle.block_inclusion_proofs(merkle.block_leaves(ledger_only(m), late=True), siblings=False)
    return proofs.select("block_index", "position", "root", "verified")


# ---- over the height from which state keys compare byte by byte -------------------------------------
ARMED = 1200
TWINS_SQL = f"""twins AS (SELECT event_id AS id, user_id % 2 AS contract_index, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS state_key, CAST(value AS DECIMAL(18,2)) || '' AS state_value,
      event_id // 10 AS block_index FROM events), folded AS (SELECT *, CASE WHEN block_index >= {ARMED} THEN state_key ELSE upper(state_key) END AS f FROM twins),
    state AS (SELECT * FROM folded WHERE id IN (SELECT max(id) FROM folded GROUP BY block_index, contract_index, f)),
    made AS (SELECT a.block_index, a.action_index, i.address AS source_address, 'code' || tx_index AS code_hash, 'valid' AS status FROM actions a LEFT JOIN index_addresses i ON i.id = a.source_id % 100 WHERE action = '2-HIGH'),
    runs AS (SELECT a.block_index, a.action_index, a.source_id AS contract_index, i.address AS caller_address, CAST(tx_index AS VARCHAR) AS gas_used, 'valid' AS status, 2 AS emitted_count
      FROM actions a LEFT JOIN index_addresses i ON i.id = a.source_id % 100 WHERE action = '1-URGENT'),
    em AS (SELECT r.block_index, l.action_index AS execution_index, l.l_returnflag AS emitted_action, l.address_id AS action_index, l.l_linenumber AS position FROM ledger_base l JOIN runs r ON r.action_index = l.action_index),
    moved AS (SELECT a.block_index, a.action_index, a.source_id AS contract_index, i.address AS source_address, k.tick, CAST(a.source_id * 3 AS VARCHAR) AS amount, 'valid' AS status, a.action
      FROM actions a LEFT JOIN index_addresses i ON i.id = a.source_id % 100 LEFT JOIN index_tickers k ON k.id = a.source_id % 20)"""
MOVE_PAIRS = (("action_index", "n"), ("contract_index", "n"), ("source_address", "s"), ("tick", "s"), ("amount", "s"), ("status", "s"))
CONTRACT_ARRAYS = (  # name, rows, columns, order
    ("contracts", "made", (("action_index", "n"), ("source_address", "s"), ("code_hash", "s"), ("status", "s")), "action_index"),
    ("state", "state", (("contract_index", "n"), ("state_key", "s"), ("state_value", "s")), "contract_index, f"),
    ("executions", "runs", (("action_index", "n"), ("contract_index", "n"), ("caller_address", "s"), ("gas_used", "s"), ("status", "s"), ("emitted_count", "n")), "action_index"),
    ("emissions", "em", (("execution_index", "n"), ("emitted_action", "s"), ("action_index", "n"), ("position", "n")), "execution_index, position"),
    ("deposits", "(SELECT * FROM moved WHERE action = '3-MEDIUM')", MOVE_PAIRS, "action_index, contract_index"),
    ("withdrawals", "(SELECT * FROM moved WHERE action = '5-LOW')", MOVE_PAIRS, "action_index, contract_index"),
)
GATED_TABLES = ("actions", "blocks", "index_addresses", "index_tickers", "ledger_base")


def gated_hash_sql() -> str:
    arrays = ", ".join(f"t_{n} AS (SELECT block_index, string_agg(j, ',' ORDER BY {order}, j) AS t FROM (SELECT *, {jtext(*pairs)} AS j FROM {rows}) GROUP BY 1)" for n, rows, pairs, order in CONTRACT_ARRAYS)
    shown = " || ".join(f"'{'{' if i == 0 else ','}\"{n}\":[' || coalesce(t_{n}.t, '') || ']'" for i, (n, *_) in enumerate(CONTRACT_ARRAYS))
    joins = " ".join(f"LEFT JOIN t_{n} ON t_{n}.block_index = b.block_index" for n, *_ in CONTRACT_ARRAYS)
    return f"WITH {TWINS_SQL}, {arrays} SELECT b.block_index, sha256({shown} || ',' {tail('contract_hash')}) AS contract_hash FROM blocks b LEFT JOIN blocks p ON p.block_index = b.block_index - 1 {joins}"


def contract_tables(m):
    """All six contract arrays; every other state key of a kind is written in capitals."""
    executions, emissions = execution_tables(m)
    e = F.col("event_id")
    state = m.table("events").select(
        e.alias("id"), (F.col("user_id") % 2).alias("contract_index"), F.when(e % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("state_key"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("state_value"), F.expr("event_id div 10").alias("block_index"))
    source, valid = (F.col("source_id") % 100).alias("source_id"), F.lit(1).cast("bigint").alias("status_id")
    moved = lambda kind: m.actions.where(F.col("action") == kind).select(
        "action_index", F.col("source_id").alias("contract_index"), source, (F.col("source_id") % 20).alias("tick_id"), (F.col("source_id") * 3).cast("string").alias("amount"), valid)
    return {"actions": m.actions, "contract_state": state, "contract_executions": executions, "contract_emissions": emissions,
            "contracts": m.actions.where("action = '2-HIGH'").select("action_index", source, F.concat(F.lit("code"), "tx_index").alias("code_hash"), valid),
            "deposits": moved("3-MEDIUM"), "withdrawals": moved("5-LOW"),
            "index_addresses": m.index_addresses, "index_tickers": m.index_tickers, "index_statuses": m.statuses}


@query("contract_hashes_gated", gated_hash_sql(), GATED_TABLES)
def contract_hashes_gated(m):
    return integrity.block_hashes(contract_tables(m), m.blocks, F.col("block_index") >= ARMED).select("block_index", "contract_hash")


def gated_leaves_sql() -> str:
    parts = []
    for rank, (name, rows, pairs, order) in enumerate(CONTRACT_ARRAYS):
        n1, n2 = ([c for c in order.split(", ") if c != "f"] + ["NULL"])[:2]
        texts = ("f", "NULL", "NULL", "NULL") if name == "state" else ("source_address", "tick", "amount", "status") if name in ("deposits", "withdrawals") else ("NULL",) * 4
        parts.append(f"SELECT block_index, {4 + rank} AS rank, {n1} AS n1, {n2} AS n2, {', '.join(f'CAST({t} AS VARCHAR) AS s{k + 1}' for k, t in enumerate(texts))}, {leaf_sql(chr(39) + 'C' + chr(39), chr(39) + name + chr(39), *[c for c, _ in pairs])} AS leaf FROM {rows}")
    return " UNION ALL ".join(parts)


@query("contract_leaf_positions", f"""WITH {TWINS_SQL} SELECT block_index, leaf, row_number() OVER (PARTITION BY block_index ORDER BY rank, n1, n2, s1, s2, s3, s4, leaf) - 1 AS position FROM ({gated_leaves_sql()})""", GATED_TABLES)
def contract_leaf_positions(m):
    """Order of the contract leaves of each block's content tree on both sides of the height."""
    leaves = merkle.block_leaves(contract_tables(m), F.col("block_index") >= ARMED).where("rank >= 4")
    return merkle.block_positions(leaves)


# ---- state trees ---------------------------------------------------------------------------------
CHAIN, NETWORK = "BTC", "regtest"


def balance_leaves(m):
    return smt.balance_leaves(m.credits, m.debits, m.index_addresses, m.index_tickers, CHAIN, NETWORK)


CONTRACT_LEAVES_SQL = f"""SELECT sha256('XCHAIN_CST' || chr(0) || 'BTC' || chr(0) || 'regtest' || chr(0) || contract_index || chr(0) || state_key) AS key, sha256(chr(0) || state_value) AS leaf FROM contract_state
    WHERE id IN (SELECT max(id) FROM contract_state GROUP BY contract_index, state_key) AND state_value IS NOT NULL"""


@query("contract_state_leaves", CONTRACT_LEAVES_SQL, ("contract_state",))
def contract_state_leaves(m):
    return smt.contract_state_leaves(m.contract_state, CHAIN, NETWORK)


ESCROW_LEAVES_SQL = f"""SELECT sha256('XCHAIN_ESC' || chr(0) || 'BTC' || chr(0) || 'regtest' || chr(0) || i.address || chr(0) || k.tick) AS key,
      sha256(chr(0) || CAST(CAST(j.locked_amount AS DECIMAL(38,18)) AS VARCHAR)) AS leaf FROM escrow_journal j JOIN index_addresses i ON i.id = j.address_id JOIN index_tickers k ON k.id = j.tick_id
    WHERE j.id IN (SELECT max(id) FROM escrow_journal GROUP BY address_id, tick_id) AND j.locked_amount IS NOT NULL AND CAST(j.locked_amount AS DECIMAL(38,18)) <> 0"""


@query("escrow_leaves", ESCROW_LEAVES_SQL,
       ("escrow_journal", "index_addresses", "index_tickers"))
def escrow_leaves(m):
    return smt.escrow_leaves(m.escrow_journal, m.index_addresses, m.index_tickers, CHAIN, NETWORK)


def stake_weights(m):
    """Capabilities are market segments: (capability, pubkey, source, weight)."""
    per_source = m.table("customer").where("c_acctbal > 0").groupBy("c_mktsegment", "c_nationkey").agg(
        F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("string").alias("weight"))
    keys = m.table("customer").where("c_acctbal > 0").select("c_mktsegment", "c_nationkey", F.col("c_name").alias("pubkey"))
    return keys.join(per_source, ["c_mktsegment", "c_nationkey"]).select(
        F.col("c_mktsegment").alias("capability"), "pubkey", F.col("c_nationkey").cast("string").alias("source"), "weight")


STAKE_LEAVES_SQL = f"""SELECT sha256('XCHAIN_STK' || chr(0) || c_name || chr(0) || c_mktsegment) AS key, sha256(chr(0) || 'STK' || chr(0) || c_nationkey || chr(0) || CAST(CAST(w AS DECIMAL(38,18)) AS VARCHAR)) AS leaf
      FROM customer JOIN (SELECT c_mktsegment, c_nationkey, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS w FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2) q USING (c_mktsegment, c_nationkey) WHERE c_acctbal > 0
    UNION ALL SELECT sha256('XCHAIN_STK' || chr(0) || '__total__' || chr(0) || c_mktsegment), sha256(chr(0) || 'STKTOTAL' || chr(0) || CAST(CAST(sum(w) AS DECIMAL(38,18)) AS VARCHAR)) FROM (SELECT c_mktsegment, c_nationkey, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS w FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2) q GROUP BY c_mktsegment"""


@query("stake_leaves", STAKE_LEAVES_SQL)
def stake_leaves(m):
    return smt.stake_leaves(stake_weights(m))


def quoted(*parts: str) -> str:
    return " || chr(0) || ".join(parts)


BALANCE_LEAVES_SQL = f"""SELECT sha256({quoted("'XCHAIN_BAL'", "'BTC'", "'regtest'", "address", "tick")}) AS key, sha256(chr(0) || CAST(net AS VARCHAR)) AS leaf FROM (
      SELECT i.address, t.tick, sum(s.amount) AS net FROM (SELECT address_id, tick_id, CAST(amount AS DECIMAL(38,18)) AS amount FROM credits
        UNION ALL SELECT address_id, tick_id, -CAST(amount AS DECIMAL(38,18)) FROM debits) s
      JOIN index_addresses i ON i.id = s.address_id JOIN index_tickers t ON t.id = s.tick_id GROUP BY i.address, t.tick HAVING sum(s.amount) <> 0)"""
TREE = ("credits", "debits", "index_addresses", "index_tickers")


def tree_sql(name: str, leaves: str) -> str:
    """Recursive fold of (key, leaf) from depth 256 up; `e` is the empty subtree of the level."""
    return f"""{name} AS (SELECT 256 AS d, CAST(CAST(unhex(key) AS BIT) AS VARCHAR) AS bits, leaf AS h, '{canon.EMPTY_ROOTS[0].hex()}' AS e FROM ({leaves})
      UNION ALL SELECT d - 1, substr(bits, 1, d - 1), sha256(unhex('01') || unhex(coalesce(max(CASE WHEN substr(bits, d, 1) = '0' THEN h END), e)) || unhex(coalesce(max(CASE WHEN substr(bits, d, 1) = '1' THEN h END), e))),
        sha256(unhex('01') || unhex(e) || unhex(e)) FROM {name} WHERE d > 0 GROUP BY d, substr(bits, 1, d - 1), e)"""


def root_sql(leaves: str) -> str:
    return f"WITH RECURSIVE {tree_sql('tree', leaves)} SELECT h AS root FROM tree WHERE d = 0"


@query("smt_root", root_sql(BALANCE_LEAVES_SQL), TREE)
def smt_root(m):
    return smt.smt_root(balance_leaves(m))


@query("smt_incremental", root_sql(BALANCE_LEAVES_SQL), TREE)
def smt_incremental(m):
    """Root after threading every height from 1200 on into the prefix roots of the state before it."""
    before = F.col("action_index") < 1200 * 1_000_000_000
    old = smt.balance_leaves(m.credits.where(before), m.debits.where(before), m.index_addresses, m.index_tickers, CHAIN, NETWORK)
    old, now = materialise(old), materialise(balance_leaves(m))
    changed = now.join(old, ["key", "leaf"], "left_anti").select("key").unionByName(old.join(now, "key", "left_anti").select("key"))
    return smt.combine(smt.update_prefix_roots(smt.prefix_roots(old), now, changed))


def leaves_below(height: int) -> str:
    """SQL of the balance leaves as of right after a height."""
    out = BALANCE_LEAVES_SQL
    for t in ("credits", "debits"):
        out = out.replace(f"FROM {t}", f"FROM {t} JOIN actions USING (action_index) WHERE block_index <= {height}")
    return out


@query("balances_roots", " UNION ALL ".join(f"SELECT {h} AS block_index, (SELECT root FROM ({root_sql(leaves_below(h))})) AS balances_root" for h in (2401, 2402)), (*TREE, "actions"))
def balances_roots(m):
    """The balances tree right after each of two heights, threaded from the balances below them."""
    low, high = 2401, 2402
    early = m.actions.where(F.col("block_index") < low).select("action_index")
    before = agg.balances(m.credits.join(early, "action_index", "left_semi"), m.debits.join(early, "action_index", "left_semi"))
    landed = {"actions": m.actions, "credits": m.credits, "debits": m.debits, "index_addresses": m.index_addresses, "index_tickers": m.index_tickers,
              "blocks": m.spark.range(low, high + 1).toDF("block_index")}
    return verify.balances_roots(before, landed, low, high, CHAIN, NETWORK)


@query("smt_nodes", f"""WITH RECURSIVE leaves AS ({BALANCE_LEAVES_SQL}), {tree_sql('tree', 'SELECT * FROM leaves')}
    SELECT h AS root, (SELECT count(*) FROM leaves) AS n_leaves, true AS shares_nodes FROM tree WHERE d = 0""", TREE)
def smt_nodes(m):
    """The tree as stored nodes: the state before height 1200 committed, then the leaves that differ; with the number of
    lone-leaf nodes that the new version reaches, which is the number of its leaves."""
    ensure_checkpoint_dir(m.spark)
    root = f"{m.spark.sparkContext.getCheckpointDir()}/tree-{uuid.uuid4().hex}"
    early = (F.col("action_index") < 1200 * 1_000_000_000).alias("early")
    rows = [t.select(*agg.PAIR, "amount", early) for t in (m.credits, m.debits)]
    sums = materialise(agg.balances(*rows, keys=[*agg.PAIR, "early"]))  # the ledger is read once, both states are sums of these
    old, now = [materialise(smt.balance_leaves(net, net.where("false"), m.index_addresses, m.index_tickers, CHAIN, NETWORK))
                for net in (sums.where("early"), sums)]
    smt_store.commit(m.spark, root, old, 1199)
    changed = materialise(now.join(old, ["key", "leaf"], "left_anti").unionByName(
        old.join(now, "key", "left_anti").select("key", F.lit(None).cast("string").alias("leaf"))))
    smt_store.commit(m.spark, root, changed, 2404)
    counts = materialise(smt_store.node_counts(m.spark, root).select(F.col("leaves").alias("n"), (F.col("stored") < 4 * F.col("live")).alias("s")))
    return smt_store.tree_root(m.spark, root).select("root", counts.select("n").scalar().alias("n_leaves"), counts.select("s").scalar().alias("shares_nodes"))


@query("smt_proofs", f"""WITH RECURSIVE leaves AS ({BALANCE_LEAVES_SQL}), {tree_sql('tree', 'SELECT * FROM leaves')}
    SELECT key, leaf AS leaf_value, (SELECT h FROM tree WHERE d = 0) AS root, true AS verified FROM leaves
    UNION ALL SELECT sha256('none|' || key), NULL, (SELECT h FROM tree WHERE d = 0), true FROM leaves""", TREE)
def smt_proofs(m):
    """Proof and its check for every balance key and for as many keys that hold nothing."""
    leaves = materialise(balance_leaves(m))  # read by the tree, the paths and the wanted keys
    absent = leaves.select(canon.sha256(F.concat(F.lit("none|"), "key")).alias("key"))
    proofs = smt.smt_proofs(leaves, leaves.select("key").unionByName(absent))
    return proofs.select("key", "leaf_value", "root", smt.verify_smt("root", "key", "leaf_value", "bitmap", "siblings").alias("verified"))


@query("contract_state_root", root_sql(CONTRACT_LEAVES_SQL), ("contract_state",))
def contract_state_root(m):
    return smt.smt_root(contract_state_leaves(m))


@query("stakes_root", root_sql(STAKE_LEAVES_SQL))
def stakes_root(m):
    return smt.smt_root(smt.stake_leaves(stake_weights(m)))


def pair_sql(a: str, b: str) -> str:
    return f"sha256(unhex('01') || unhex({a}) || unhex({b}))"


PAD, NONE = f"'{canon.EMPTY_ROOTS[0].hex()}'", f"'{canon.EMPTY_SMT_ROOT}'"


@query("state_root", f"""WITH RECURSIVE {tree_sql('bt', BALANCE_LEAVES_SQL + ' UNION ALL ' + ESCROW_LEAVES_SQL)}, {tree_sql('st', STAKE_LEAVES_SQL)}, {tree_sql('ct', CONTRACT_LEAVES_SQL)},
    r AS (SELECT (SELECT h FROM bt WHERE d = 0) AS balances_root, (SELECT h FROM st WHERE d = 0) AS stakes_root, (SELECT h FROM ct WHERE d = 0) AS contract_state_root)
    SELECT *, {pair_sql(pair_sql(pair_sql('balances_root', 'stakes_root'), pair_sql(NONE, NONE)), pair_sql(pair_sql('contract_state_root', PAD), pair_sql(PAD, PAD)))} AS state_root FROM r""",
       (*TREE, "escrow_journal", "contract_state"))
def state_root(m):
    """The committed slots and the state root over them."""
    with_escrow = balance_leaves(m).unionByName(escrow_leaves(m))
    trees = [("balances_root", with_escrow), ("stakes_root", smt.stake_leaves(stake_weights(m))), ("contract_state_root", contract_state_leaves(m))]
    leaves = None
    for name, df in trees:
        part = df.withColumn("tree", F.lit(name))
        leaves = part if leaves is None else leaves.unionByName(part)
    roots = smt.smt_root(leaves, tree=["tree"])
    row = roots.agg(*[F.max(F.when(F.col("tree") == n, F.col("root"))).alias(n) for n, _ in trees])
    return row.withColumn("state_root", canon.state_root(**{n: F.col(n) for n, _ in trees}))


@query("orphan_nodes", """WITH RECURSIVE nodes AS (SELECT 'n' || o_orderkey AS node_hash, 'n' || (2 * o_orderkey + 1) AS left_hash, CASE WHEN o_orderkey % 5 <> 0 THEN 'n' || (2 * o_orderkey + 2) END AS right_hash FROM orders),
    reach AS (SELECT 'n' || o_orderkey AS node_hash FROM orders WHERE o_orderkey IN (0, 3, 11) UNION SELECT c.node_hash FROM reach r JOIN nodes p ON p.node_hash = r.node_hash
      JOIN nodes c ON c.node_hash = p.left_hash OR c.node_hash = p.right_hash)
    SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM reach) AS reachable_nodes, (SELECT count(*) FROM nodes) - (SELECT count(*) FROM reach) AS orphan_count""")
def orphan_nodes(m):
    key = F.col("o_orderkey")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    nodes = m.table("orders").select(name(key).alias("node_hash"), name(key * 2 + 1).alias("left_hash"),
                                     F.when(key % 5 != 0, name(key * 2 + 2)).alias("right_hash"))
    roots = m.table("orders").where("o_orderkey in (0, 3, 11)").select(name(key).alias("node_hash"))
    return smt.orphan_stats(nodes, roots)
