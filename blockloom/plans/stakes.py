"""Stake, validator-set and quorum queries."""

from pyspark.sql import functions as F

from blockloom.operators import stake
from blockloom.plans.registry import query

HEIGHT = 1200
TABLES = ("stakes", "delegations", "revocations", "slash_events", "statuses", "slash_debits")

ADDBACK = """LEFT JOIN (SELECT stake_action_index, sum(CAST(amount AS DECIMAL(30,8))) AS cut FROM slash_debits
    WHERE target_table = 'stakes' AND block_index > 1200 GROUP BY 1) a ON a.stake_action_index = s.action_index"""


def weights_sql(as_of: bool) -> str:
    added = " + coalesce(a.cut, 0)" if as_of else ""
    return f"""q AS (SELECT s.source_id, sum(CAST(s.amount AS DECIMAL(30,8)){added}) AS weight FROM stakes s
      {ADDBACK if as_of else ''} WHERE s.status_id = 1 AND s.activation_block <= 1200
        AND (s.deactivation_block IS NULL OR s.deactivation_block > 1200)
      GROUP BY 1 HAVING sum(CAST(s.amount AS DECIMAL(30,8)){added}) >= 20000),
    ek AS (SELECT s.source_id, s.signing_pubkey_id FROM stakes s WHERE s.status_id = 1 AND s.activation_block <= 1200
        AND (s.deactivation_block IS NULL OR s.deactivation_block > 1200)
        AND NOT EXISTS (SELECT 1 FROM revocations r WHERE r.source_id = s.source_id AND r.signing_pubkey_id = s.signing_pubkey_id
          AND r.status_id = 1 AND r.deactivation_block <= 1200 AND r.action_index > s.action_index)
        AND NOT EXISTS (SELECT 1 FROM slash_events e WHERE e.signing_pubkey_id = s.signing_pubkey_id AND e.block_index <= 1200)
      UNION SELECT d.source_id, d.signing_pubkey_id FROM delegations d WHERE d.status_id = 1 AND d.activation_block <= 1200
        AND (d.deactivation_block IS NULL OR d.deactivation_block > 1200)
        AND NOT EXISTS (SELECT 1 FROM slash_events e WHERE e.signing_pubkey_id = d.signing_pubkey_id AND e.block_index <= 1200)),
    sw AS (SELECT c.c_name AS pubkey, n.n_name AS source, q.weight FROM q JOIN ek USING (source_id)
      JOIN nation n ON n.n_nationkey = q.source_id JOIN customer c ON c.c_custkey = ek.signing_pubkey_id)"""


def weights(m, as_of: bool = False):
    addresses = m.table("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("address"))
    pubkeys = m.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("pubkey"))
    return stake.stake_weights(m.stakes, m.delegations, m.revocations, m.slash_events, m.statuses, addresses, pubkeys,
                               HEIGHT, 20000, m.slash_debits if as_of else None)


@query("stake_weights", f"WITH {weights_sql(False)} SELECT pubkey, source, CAST(CAST(weight AS DECIMAL(38,8)) AS VARCHAR) AS weight FROM sw", TABLES)
def stake_weights(m):
    return weights(m).withColumn("weight", F.col("weight").cast("decimal(38,8)").cast("string"))


@query("stake_weights_asof", f"WITH {weights_sql(True)} SELECT pubkey, source, CAST(CAST(weight AS DECIMAL(38,8)) AS VARCHAR) AS weight FROM sw", TABLES)
def stake_weights_asof(m):
    return weights(m, True).withColumn("weight", F.col("weight").cast("decimal(38,8)").cast("string"))


@query("stake_capped", f"""WITH {weights_sql(False)}, r AS (SELECT *, dense_rank() OVER (ORDER BY source) AS sr,
      row_number() OVER (PARTITION BY source ORDER BY pubkey) AS kr FROM sw)
    SELECT pubkey, source, CAST(CAST(weight AS DECIMAL(38,8)) AS VARCHAR) AS weight, CAST(sr AS INTEGER) AS source_rank,
      CAST(kr AS INTEGER) AS key_rank, (SELECT max(sr) FROM r) > 10 AS truncated FROM r WHERE sr <= 10 AND kr <= 4""", TABLES)
def stake_capped(m):
    return stake.cap_sources(weights(m), 10, 4).withColumn("weight", F.col("weight").cast("decimal(38,8)").cast("string"))


@query("stake_row_cap", f"""WITH {weights_sql(False)}, c AS (SELECT * FROM sw ORDER BY source, pubkey LIMIT 100)
    SELECT pubkey, source, CAST(CAST(weight AS DECIMAL(38,8)) AS VARCHAR) AS weight, count(*) OVER () >= 100 AS truncated FROM c""", TABLES)
def stake_row_cap(m):
    return stake.cap_rows(weights(m), 100).withColumn("weight", F.col("weight").cast("decimal(38,8)").cast("string"))


# Checkpoints: one per order date month-like bucket of 100 heights; customers of the orders in the
# bucket are its members, those with an urgent order are its signers.
MEMBERS_SQL = """members AS (SELECT DISTINCT o.block_index // 100 AS seq, c.c_name AS pubkey, c.c_nationkey AS source,
      CAST(n.bal AS VARCHAR) AS weight FROM orders_base o JOIN customer c ON c.c_custkey = o.o_custkey
      JOIN (SELECT c_nationkey, sum(CAST(abs(c_acctbal) AS DECIMAL(18,2))) AS bal FROM customer GROUP BY 1) n USING (c_nationkey)),
    signers AS (SELECT DISTINCT o.block_index // 100 AS seq, c.c_name AS pubkey FROM orders_base o
      JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderpriority = '1-URGENT' AND c.c_nationkey % 4 <> (o.block_index // 100) % 3)"""


def members(m):
    customers = m.table("customer").select("c_custkey", F.col("c_name").alias("pubkey"), "c_nationkey")
    stake_of = m.table("customer").groupBy("c_nationkey").agg(
        F.sum(F.abs("c_acctbal").cast("decimal(18,2)")).cast("string").alias("weight"))
    seq = F.expr("block_index div 100")
    seen = m.orders_base.select(seq.alias("seq"), F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    joined = seen.join(customers, "c_custkey").join(stake_of, "c_nationkey")
    all_members = joined.select("seq", "pubkey", F.col("c_nationkey").alias("source"), "weight").distinct().withColumn(
        "truncated", F.lit(False))
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("c_nationkey") % 4 != F.col("seq") % 3)
    signers = joined.where(urgent).select("seq", "pubkey").distinct()
    return all_members, signers


@query("quorum_tally", f"""WITH {MEMBERS_SQL}, s AS (SELECT m.seq, m.source, max(CAST(m.weight AS DECIMAL(38,8))) AS w,
      bool_or(g.pubkey IS NOT NULL) AS signed FROM members m LEFT JOIN signers g ON g.seq = m.seq AND g.pubkey = m.pubkey GROUP BY 1, 2)
    SELECT seq, CAST(CAST(sum(w) AS DECIMAL(38,8)) AS VARCHAR) AS total_stake,
      CAST(CAST(coalesce(sum(w) FILTER (WHERE signed), 0) AS DECIMAL(38,8)) AS VARCHAR) AS signed_stake,
      coalesce(sum(w) FILTER (WHERE signed), 0) * 3 > sum(w) * 2 AS meets_quorum FROM s GROUP BY seq""", ("orders_base",))
def quorum_tally(m):
    all_members, signers = members(m)
    out = stake.stake_quorum(all_members, signers, ["seq"])
    return out.withColumns({c: F.col(c).cast("decimal(38,8)").cast("string") for c in ("total_stake", "signed_stake")})


@query("count_quorum", f"""WITH {MEMBERS_SQL}, v AS (SELECT m.seq, count(DISTINCT m.pubkey) AS n_members, count(DISTINCT g.pubkey) AS valid_signatures
      FROM members m LEFT JOIN signers g ON g.seq = m.seq AND g.pubkey = m.pubkey GROUP BY 1)
    SELECT *, valid_signatures >= quorum AS valid FROM (SELECT *, CAST(CASE WHEN n_members <= 1 THEN 1
      ELSE greatest(2 * ((n_members - 1) // 3) + 1, (n_members + 2) // 2) END AS BIGINT) AS quorum FROM v)""", ("orders_base",))
def count_quorum(m):
    all_members, signers = members(m)
    return stake.count_quorum(all_members, signers.withColumn("sig_valid", F.lit(True)), ["seq"])


CHECKPOINT_SQL = f"""{MEMBERS_SQL}, s AS (SELECT m.seq, m.source, max(CAST(m.weight AS DECIMAL(38,8))) AS w,
      bool_or(g.pubkey IS NOT NULL) AS signed FROM members m LEFT JOIN signers g ON g.seq = m.seq AND g.pubkey = m.pubkey GROUP BY 1, 2),
    st AS (SELECT seq, coalesce(sum(w) FILTER (WHERE signed), 0) * 3 > sum(w) * 2 AS staked FROM s GROUP BY 1),
    ct AS (SELECT m.seq, count(DISTINCT m.pubkey) AS n, count(DISTINCT g.pubkey) AS k FROM members m
      LEFT JOIN signers g ON g.seq = m.seq AND g.pubkey = m.pubkey GROUP BY 1),
    cp AS (SELECT seq, seq % 5 = 4 AS commitment_missing, seq % 2 = 0 AS weighted, seq * 100 + 99 AS block_index FROM (SELECT DISTINCT block_index // 100 AS seq FROM orders_base)),
    v AS (SELECT cp.*, CASE WHEN commitment_missing THEN false WHEN weighted THEN staked
      ELSE k >= greatest(2 * ((n - 1) // 3) + 1, (n + 2) // 2) END AS valid FROM cp JOIN st USING (seq) JOIN ct USING (seq))"""


def verdicts(m):
    all_members, signers = members(m)
    seq = F.col("checkpoint_seq")
    checkpoints = m.orders_base.select(F.expr("block_index div 100").alias("checkpoint_seq")).distinct().select(
        "checkpoint_seq", (seq % 5 == 4).alias("commitment_missing"), (seq % 2 == 0).alias("weighted"),
        (seq * 100 + 99).alias("block_index"))
    return stake.checkpoint_verdicts(checkpoints, all_members.withColumnRenamed("seq", "checkpoint_seq"),
                                     signers.withColumnRenamed("seq", "checkpoint_seq").withColumn("sig_valid", F.lit(True)))


@query("checkpoint_verdict", f"WITH {CHECKPOINT_SQL} SELECT seq AS checkpoint_seq, valid FROM v", ("orders_base",))
def checkpoint_verdict(m):
    return verdicts(m).select("checkpoint_seq", "valid")


@query("checkpoint_anchor", f"""WITH {CHECKPOINT_SQL} SELECT seq AS checkpoint_seq, 2300 - v.block_index > 500 AS stale, CASE
      WHEN commitment_missing THEN 'no commitment' WHEN seq < 3 THEN 'sequence regression' WHEN v.block_index > 2300 THEN 'ahead of replica'
      WHEN NOT valid THEN 'halt: quorum invalid' WHEN b.block_index IS NULL THEN 'height not recomputed'
      WHEN seq % 7 = 0 THEN 'halt: root mismatch' ELSE 'anchored' END AS verdict
    FROM v LEFT JOIN blocks b ON b.block_index = v.block_index""", ("orders_base", "blocks"))
def checkpoint_anchor(m):
    from blockloom.functions.canon import sha256
    root = sha256(F.concat(F.lit("root|"), F.col("block_index").cast("string")))
    served = verdicts(m).withColumns({
        "state_root": F.when(~F.col("commitment_missing"), F.when(F.col("checkpoint_seq") % 7 == 0, F.lit("00")).otherwise(F.upper(root))),
        "block_merkle_root": F.lit(None).cast("string")})
    local = m.blocks.select("block_index", root.alias("state_root"), root.alias("block_merkle_root"))
    return stake.anchor_verdicts(served, local, tip=2300, last_seq=3, freshness=500).select("checkpoint_seq", "stale", "verdict")


@query("checkpoint_follow", f"""WITH {CHECKPOINT_SQL}, j AS (SELECT seq % 3 AS chain, seq, block_index,
      CASE WHEN block_index > 2300 OR commitment_missing THEN 'wait' WHEN seq % 11 = 10 THEN 'divergence' ELSE 'ok' END AS outcome FROM v WHERE block_index > 299),
    k AS (SELECT *, min(CASE WHEN outcome <> 'ok' THEN block_index END) OVER (PARTITION BY chain ORDER BY block_index) AS broken FROM j)
    SELECT chain, seq AS checkpoint_seq, CASE WHEN broken IS NULL THEN 'ok' WHEN broken = block_index THEN outcome ELSE 'wait' END AS verdict FROM k""", ("orders_base",))
def checkpoint_follow(m):
    seq = F.col("checkpoint_seq")
    chain = verdicts(m).select(
        (seq % 3).alias("chain"), "checkpoint_seq", "block_index",
        F.when(~F.col("commitment_missing"), "root").alias("state_root"), F.lit(0).cast("bigint").alias("snapshot_block"),
        (seq % 11 != 10).alias("valid"), F.lit("match").alias("root_status"))
    return stake.follow_forward(chain, 299, 2300).select("chain", "checkpoint_seq", "verdict")


@query("hash_tuple_votes", """WITH t AS (SELECT block_index, ledger_hash, count(DISTINCT source) AS n_sources,
      string_agg(DISTINCT CAST(source AS VARCHAR), ',' ORDER BY CAST(source AS VARCHAR)) AS sources FROM publisher_blocks GROUP BY 1, 2)
    SELECT *, n_sources >= 2 AS agreed FROM t""", ("publisher_blocks",))
def hash_tuple_votes(m):
    from blockloom.operators.follow import hash_votes
    return hash_votes(m.publisher_blocks, ["ledger_hash"], n_sources=3)
