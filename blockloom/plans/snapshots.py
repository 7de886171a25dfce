"""Snapshot, bootstrap and reconcile queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators import epochs as ep
from blockloom.operators import snapshot
from blockloom.plans.integrity import BAGS, digest_sql
from blockloom.plans.registry import query
from blockloom.sources.driver_model import GAS_TICK

BLOCK_COLUMNS = ("block_index", "block_time", "ledger_hash", "actions_hash", "contract_hash")


@query("snapshot_manifest", f"""WITH {digest_sql({**BAGS, 'blocks': ('blocks', BLOCK_COLUMNS), 'index_addresses': ('index_addresses', ('id', 'address', 'block_index'))})}
    SELECT "table", CAST(CASE "table" WHEN 'index_addresses' THEN 0 WHEN 'blocks' THEN 1 WHEN 'credits' THEN 2 WHEN 'debits' THEN 3 ELSE 4 END AS INTEGER) AS position, n_rows, digest FROM digests""",
       ("credits", "debits", "escrows", "blocks", "index_addresses"))
def snapshot_manifest(m):
    return snapshot.snapshot_manifest({"escrows": m.escrows, "debits": m.debits, "credits": m.credits, "blocks": m.blocks, "index_addresses": m.index_addresses})


@query("bootstrap_window", """WITH tip AS (SELECT max(block_index) - 100 AS base, max(block_index) AS tip FROM blocks), d AS (SELECT debits.* FROM debits JOIN actions USING (action_index), tip WHERE block_index BETWEEN base AND tip),
      a AS (SELECT actions.* FROM actions, tip WHERE block_index BETWEEN base AND tip),
      ids AS (SELECT address_id AS id FROM d UNION SELECT tick_id FROM d UNION SELECT source_id FROM a)
    SELECT 'base' AS "table", base AS key, '' AS value FROM tip
    UNION ALL SELECT 'blocks', block_index, coalesce(ledger_hash, '') FROM blocks, tip WHERE block_index BETWEEN base AND tip
    UNION ALL SELECT 'debits', action_index, amount FROM d
    UNION ALL SELECT 'index_addresses', id, address FROM index_addresses WHERE id % 3 <> 0 OR id IN (SELECT id FROM ids)""",
       ("blocks", "actions", "debits", "index_addresses"))
def bootstrap_window(m):
    """Lookups were paged when every third address was not there yet; the window's own ones are fetched after it."""
    tables = {"blocks": m.blocks, "actions": m.actions, "debits": m.debits, "index_addresses": m.index_addresses.select("id", "address")}
    paged = {"index_addresses": tables["index_addresses"].where("id % 3 <> 0")}
    base, data, _, lookups = snapshot.bootstrap_window(paged, lambda: tables, 100, None, GAS_TICK, m.statuses)
    shown = [(data["blocks"], "blocks", "block_index", "ledger_hash"), (data["debits"], "debits", "action_index", "amount"), (lookups["index_addresses"], "index_addresses", "id", "address")]
    rows = [df.select(F.lit(t).alias("table"), F.col(k).cast("bigint").alias("key"), F.coalesce(F.col(v), F.lit("")).alias("value")) for df, t, k, v in shown]
    return reduce(DataFrame.unionByName, rows).unionByName(m.spark.range(1).select(F.lit("base").alias("table"), F.lit(base).cast("bigint").alias("key"), F.lit("").alias("value")))


@query("reconcile_diff", """WITH e AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0),
      s AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0)
    SELECT CASE WHEN e.o_orderkey IS NULL THEN 'insert' WHEN s.o_orderkey IS NULL THEN 'delete' WHEN e.o_orderstatus = s.o_orderstatus THEN 'keep' ELSE 'update' END AS action,
      coalesce(s.o_orderkey, e.o_orderkey) AS o_orderkey, coalesce(s.o_custkey, e.o_custkey) AS o_custkey, coalesce(s.o_orderstatus, e.o_orderstatus) AS o_orderstatus
    FROM e FULL JOIN s ON e.o_orderkey = s.o_orderkey AND e.o_custkey = s.o_custkey""")
def reconcile_diff(m):
    orders = m.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    status = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    return snapshot.reconcile_diff(orders.where("o_orderkey % 5 <> 0"), orders.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", status), ["o_orderkey", "o_custkey"])


@query("epoch_markers", """WITH p AS (SELECT o_custkey AS epoch, o_orderkey AS seq, 'old' || o_orderkey AS old_root FROM orders WHERE o_orderkey % 3 = 0),
      c AS (SELECT o_custkey AS epoch, o_orderkey AS seq, 'new' || o_orderkey AS root FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT p.seq, p.epoch, p.old_root, (SELECT arg_min(root, c.seq) FROM c WHERE c.epoch = p.epoch AND c.seq > p.seq) AS new_root FROM p
    WHERE NOT EXISTS (SELECT 1 FROM p AS q WHERE q.epoch = p.epoch AND q.seq < p.seq AND NOT EXISTS (SELECT 1 FROM c WHERE c.epoch = p.epoch AND c.seq > q.seq AND c.seq < p.seq))""")
def epoch_markers(m):
    """Orders of a customer stand for the prunes and commits of one epoch, in the order of their numbers."""
    o = m.table("orders").select(F.col("o_custkey").alias("epoch"), F.col("o_orderkey").alias("seq"))
    name = lambda n: F.concat(F.lit(n), F.col("seq").cast("string"))
    return ep.marker_chain(o.where("seq % 3 = 0").withColumn("old_root", name("old")), o.where("seq % 3 <> 0").withColumn("merkle_root", name("new")))
