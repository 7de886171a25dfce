"""Batch twins of the stream operators over the publisher events."""

from pyspark.sql import functions as F

from blockloom.functions import canon
from blockloom.operators import follow
from blockloom.plans.registry import query

TALLY = """t AS (SELECT block_index, ledger_hash, count(DISTINCT source) AS n FROM publisher_blocks GROUP BY 1, 2),
    h AS (SELECT block_index, CAST(sum(n) AS BIGINT) AS n_reported, max(n) AS n_agreeing, max(ledger_hash) FILTER (WHERE n >= 2) AS ledger_hash FROM t GROUP BY 1)"""


@query("quorum_apply", f"""WITH {TALLY} SELECT block_index, n_reported, n_agreeing, CASE WHEN n_agreeing >= 2 THEN 'apply'
    WHEN n_reported >= 3 THEN 'halt' ELSE 'apply primary' END AS verdict, ledger_hash FROM h""", ("publisher_blocks",))
def quorum_apply(m):
    return follow.agreement(m.publisher_blocks, ["ledger_hash"], n_sources=3)


STRIKES = f"""{TALLY}, s AS (SELECT DISTINCT p.source, p.block_index FROM publisher_blocks p JOIN h ON h.block_index = p.block_index
      WHERE h.ledger_hash IS NOT NULL AND p.ledger_hash <> h.ledger_hash),
    c AS (SELECT source, block_index, count(*) OVER (PARTITION BY source ORDER BY block_index RANGE BETWEEN 199 PRECEDING AND CURRENT ROW) AS n_strikes FROM s)"""


@query("source_strikes", f"WITH {STRIKES} SELECT * FROM c", ("publisher_blocks",))
def source_strikes(m):
    return follow.strike_counts(follow.strikes(m.publisher_blocks, ["ledger_hash"], n_sources=3))


@query("source_evictions", f"""WITH {STRIKES}, f AS (SELECT source, min(block_index) AS evicted_at FROM c WHERE n_strikes >= 3 GROUP BY 1)
    SELECT source, evicted_at, row_number() OVER (ORDER BY evicted_at, source) <= 1 AS evicted FROM f""", ("publisher_blocks",))
def source_evictions(m):
    counts = follow.strike_counts(follow.strikes(m.publisher_blocks, ["ledger_hash"], n_sources=3))
    return follow.evictions(counts, n_sources=3)


@query("fork_point", """WITH src AS (SELECT block_index, sha256('b|' || block_index) AS hash FROM blocks),
    rec AS (SELECT block_index, CASE WHEN block_index BETWEEN 1990 AND 2050 OR block_index % 97 = 0 THEN sha256('old|' || block_index) ELSE sha256('b|' || block_index) END AS hash FROM blocks),
    d AS (SELECT s.block_index FROM src s JOIN rec r USING (block_index) WHERE s.hash <> r.hash AND s.block_index BETWEEN 1 AND 2050 UNION SELECT 2051)
    SELECT max(block_index) AS fork_block FROM d WHERE block_index - 1 NOT IN (SELECT block_index FROM d)""", ("blocks",))
def fork_point(m):
    b = F.col("block_index")
    new, old = (canon.sha256(F.concat(F.lit(p), b.cast("string"))) for p in ("b|", "old|"))
    recorded = m.blocks.select("block_index", F.when(b.between(1990, 2050) | (b % 97 == 0), old).otherwise(new).alias("hash"))
    return follow.fork_point(m.blocks.select("block_index", new.alias("hash")), recorded, 2051)


@query("gap_ranges", """SELECT block_index + 1 AS from_block, nxt - 1 AS to_block FROM (SELECT block_index, lead(block_index) OVER (ORDER BY block_index) AS nxt
    FROM (SELECT DISTINCT block_index FROM publisher_blocks WHERE source = 1)) WHERE nxt > block_index + 1""", ("publisher_blocks",))
def gap_ranges(m):
    return follow.gap_ranges(m.publisher_blocks.where("source = 1"), bucket=500)


@query("reorg_verdicts", """SELECT event_id, block_index, CASE WHEN block_index > 600 THEN 'ignored: above tip' WHEN 600 - block_index + 1 > 100 THEN 'halt: too deep' ELSE 'rollback' END AS verdict
    FROM (SELECT event_id, event_id // 10 AS block_index FROM events WHERE event_type = 'purchase')""")
def reorg_verdicts(m):
    reorgs = m.table("events").where("event_type = 'purchase'").select("event_id", F.expr("event_id div 10").alias("block_index"))
    return follow.reorg_verdicts(reorgs, tip=600)


BEATS = """b AS (SELECT user_id AS validator_id, CASE WHEN event_id % 7 <> 0 THEN event_id // 10 END AS applied_height, event_id AS seen_at FROM events),
    l AS (SELECT validator_id, max(seen_at) AS seen_at FROM b GROUP BY 1), r AS (SELECT DISTINCT s_suppkey * 2 AS validator_id FROM supplier),
    j AS (SELECT coalesce(l.validator_id, r.validator_id) AS validator_id, b.applied_height, l.seen_at, r.validator_id IS NOT NULL AS on_roster
      FROM l JOIN b ON b.validator_id = l.validator_id AND b.seen_at = l.seen_at FULL JOIN r ON r.validator_id = l.validator_id),
    st AS (SELECT validator_id, applied_height, seen_at, greatest(0, 1000 - applied_height) AS lag_blocks, CASE WHEN seen_at IS NULL THEN 'absent'
      WHEN 10000 - seen_at > 100 THEN 'stale' WHEN applied_height IS NULL THEN 'unknown' ELSE 'known' END AS status, on_roster
      FROM j WHERE on_roster OR 10000 - seen_at <= 200)"""


def beats(m):
    e = F.col("event_id")
    rows = m.table("events").select(
        F.col("user_id").alias("validator_id"), F.when(e % 7 != 0, F.expr("event_id div 10")).alias("applied_height"), e.alias("seen_at"))
    roster = m.table("supplier").select((F.col("s_suppkey") * 2).alias("validator_id"))
    return follow.heartbeat_status(rows, roster, now=10000, ttl=100, source_height=1000)


@query("heartbeat_status", f"WITH {BEATS} SELECT validator_id, applied_height, seen_at, CASE WHEN applied_height IS NULL THEN NULL ELSE lag_blocks END AS lag_blocks, status, on_roster FROM st")
def heartbeat_status(m):
    return beats(m)


@query("heartbeat_summary", f"""WITH {BEATS} SELECT count(*) FILTER (WHERE status NOT IN ('absent', 'stale')) AS total, count(*) FILTER (WHERE on_roster) AS expected_total,
    count(*) FILTER (WHERE status <> 'absent' AND applied_height IS NULL) AS unknown_count, max(CASE WHEN applied_height IS NOT NULL THEN lag_blocks END) AS max_lag FROM st""")
def heartbeat_summary(m):
    return follow.heartbeat_summary(beats(m))


@query("replica_lag", """WITH s AS (SELECT user_id AS subscriber, max(event_id // 10) AS last_sent FROM events WHERE event_type IN ('view', 'click') GROUP BY 1),
    a AS (SELECT user_id AS subscriber, max(event_id // 10) AS last_applied, max(event_id) AS seen_at FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT coalesce(s.subscriber, a.subscriber) AS subscriber, last_sent, last_applied, coalesce(10000 - seen_at > 500, true) AS stale,
      CASE WHEN last_sent IS NOT NULL AND last_applied IS NOT NULL AND NOT coalesce(10000 - seen_at > 500, true) THEN greatest(0, last_sent - last_applied) END AS lag_blocks
    FROM s FULL JOIN a ON s.subscriber = a.subscriber""")
def replica_lag(m):
    e = m.table("events").select(F.col("user_id").alias("subscriber"), F.expr("event_id div 10").alias("block_index"),
                                 F.col("event_id").alias("seen_at"), "event_type")
    return follow.replica_lag(e.where("event_type in ('view', 'click')"), e.where("event_type = 'purchase'"), 10000, 500)


@query("source_threshold", """SELECT o_orderkey AS n, CAST(least(o_orderkey // 2 + 1, greatest(1, o_orderkey)) AS BIGINT) AS quorum FROM orders""")
def source_threshold(m):
    from blockloom.operators.stake import source_threshold as need
    return m.table("orders").select(F.col("o_orderkey").alias("n"), need(F.col("o_orderkey")).alias("quorum"))
