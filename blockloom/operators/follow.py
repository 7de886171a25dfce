"""Batch twins of the stream logic: agreement, strikes, forks, gaps, heartbeats, lag."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.fixed_values import MAX_ROLLBACK_DEPTH, STRIKE_THRESHOLD, STRIKE_WINDOW
from blockloom.functions.canon import lag_blocks


def _threshold(n_sources: int, quorum: int | None, active: int | None = None) -> int:
    active = n_sources if active is None else active
    return min(n_sources // 2 + 1 if quorum is None else quorum, max(1, active))


def latest_reports(reports: DataFrame, hashes: list[str], order: str = "seq") -> DataFrame:
    """A source's newest report per height; a re-sent block replaces the older one."""
    newest = F.max_by(F.struct(*hashes), F.col(order))
    return reports.groupBy("block_index", "source").agg(newest.alias("__h")).select(
        "block_index", "source", *[F.col(f"__h.{h}").alias(h) for h in hashes])


def hash_votes(reports: DataFrame, hashes: list[str], n_sources: int, quorum: int | None = None) -> DataFrame:
    """Sources grouped by what they report per height; `agreed` marks a group at quorum."""
    need = _threshold(n_sources, quorum)
    votes = latest_reports(reports, hashes).groupBy("block_index", *hashes).agg(
        F.count("*").alias("n_sources"),
        F.array_join(F.sort_array(F.collect_list(F.col("source").cast("string"))), ",").alias("sources"))
    return votes.withColumn("agreed", F.col("n_sources") >= need)


def agreement(reports: DataFrame, hashes: list[str], n_sources: int, quorum: int | None = None,
              strict: bool = False) -> DataFrame:
    """Verdict per height: apply at quorum, halt when every source spoke without one, otherwise
    what the timeout does (apply from the primary, or hold when strict)."""
    need = _threshold(n_sources, quorum)
    votes = latest_reports(reports, hashes).groupBy("block_index", *hashes).agg(F.count("*").alias("n"))
    per_height = votes.groupBy("block_index").agg(
        F.sum("n").alias("n_reported"), F.max("n").alias("n_agreeing"),
        F.max_by(F.struct(*hashes), F.struct("n", *hashes)).alias("__best"))
    verdict = (F.when(F.col("n_agreeing") >= need, "apply")
               .when(F.col("n_reported") >= n_sources, "halt")
               .otherwise("hold" if strict else "apply primary"))
    chosen = [F.when(F.col("n_agreeing") >= need, F.col(f"__best.{h}")).alias(h) for h in hashes]
    return per_height.select("block_index", "n_reported", "n_agreeing", verdict.alias("verdict"), *chosen)


def strikes(reports: DataFrame, hashes: list[str], n_sources: int, quorum: int | None = None) -> DataFrame:
    """One row per (source, height) where the source dissented from an agreed hash."""
    latest = latest_reports(reports, hashes)
    agreed = agreement(reports, hashes, n_sources, quorum).where("verdict = 'apply'").select(
        "block_index", *[F.col(h).alias(f"__{h}") for h in hashes])
    differs: Column = F.lit(False)
    for h in hashes:
        differs = differs | ~F.col(h).eqNullSafe(F.col(f"__{h}"))
    return latest.join(agreed, "block_index").where(differs).select("source", "block_index")


def strike_counts(strike_rows: DataFrame, window: int = STRIKE_WINDOW) -> DataFrame:
    """Strikes of a source in the `window` heights ending at each strike.

    A source may own most rows, so its heights are cut into buckets as wide as the window; a
    bucket borrows the previous one as context and holds at most 2 x window heights.
    """
    own = strike_rows.distinct().withColumn("bucket", F.floor(F.col("block_index") / window))
    context = own.withColumn("bucket", F.col("bucket") + 1)
    both = own.withColumn("__own", F.lit(True)).unionByName(context.withColumn("__own", F.lit(False)))
    trailing = Window.partitionBy("source", "bucket").orderBy("block_index").rangeBetween(-(window - 1), 0)
    return both.withColumn("n_strikes", F.count("*").over(trailing)).where("__own").select(
        "source", "block_index", "n_strikes")


def evictions(counts: DataFrame, n_sources: int, threshold: int = STRIKE_THRESHOLD) -> DataFrame:
    """First height each source reaches the threshold, and whether it may go: never below two left.

    One row per source, so the ranking sees at most `n_sources` rows.
    """
    first = counts.where(F.col("n_strikes") >= threshold).groupBy("source").agg(
        F.min("block_index").alias("evicted_at"))
    order = Window.orderBy("evicted_at", "source")
    return first.withColumn("evicted", F.row_number().over(order) <= n_sources - 2)


def fork_point(source: DataFrame, recorded: DataFrame, head: int) -> DataFrame:
    """Lowest height of the unbroken run of changed hashes that ends at `head`.

    A run starts at a changed height whose predecessor is not changed; the highest start at or
    below the head is the fork.
    """
    changed = (source.select("block_index", F.col("hash").alias("s"))
               .join(recorded.select("block_index", F.col("hash").alias("r")), "block_index")
               .where((F.col("s") != F.col("r")) & F.col("block_index").between(1, head - 1)).select("block_index"))
    spark = source.sparkSession
    marked = changed.union(spark.range(head, head + 1).toDF("block_index")).distinct()
    after = marked.select((F.col("block_index") + 1).alias("block_index"))
    return marked.join(after, "block_index", "left_anti").agg(F.max("block_index").alias("fork_block"))


def gap_ranges(present: DataFrame, bucket: int = 10_000) -> DataFrame:
    """Missing height ranges between the lowest and highest present height.

    Neighbours are found inside buckets; only one (low, high) pair per bucket meets in the
    second step, which looks across bucket edges.
    """
    heights = present.select("block_index").distinct().withColumn("b", F.floor(F.col("block_index") / bucket))
    inside = Window.partitionBy("b").orderBy("block_index")
    pairs = heights.withColumn("next", F.lead("block_index").over(inside)).where("next is not null").select(
        "block_index", "next")
    edges = heights.groupBy("b").agg(F.min("block_index").alias("low"), F.max("block_index").alias("high"))
    across = Window.orderBy("b")
    joints = edges.select(F.col("high").alias("block_index"), F.lead("low").over(across).alias("next")).where(
        "next is not null")
    return pairs.unionByName(joints).where("next > block_index + 1").select(
        (F.col("block_index") + 1).alias("from_block"), (F.col("next") - 1).alias("to_block"))


def reorg_verdicts(reorgs: DataFrame, tip: int | None, max_depth: int = MAX_ROLLBACK_DEPTH) -> DataFrame:
    """What a reorg event does to a replica at `tip`."""
    if tip is None:
        return reorgs.withColumn("verdict", F.lit("ignored: empty replica"))
    depth = F.lit(tip) - F.col("block_index") + 1
    return reorgs.withColumn("verdict", F.when(F.col("block_index") > tip, "ignored: above tip")
                             .when(depth > max_depth, "halt: too deep").otherwise("rollback"))


def batch_verdicts(shown: DataFrame, blocks: DataFrame, fields: list[str], max_depth: int = MAX_ROLLBACK_DEPTH) -> DataFrame:
    """What each batch of shown blocks (batch, block_index and hashes) means to a replica that holds `blocks`: a row
    per batch with its verdict, lowest fork height, and the heights it lacks above the tip.

    `skip`: only known blocks.  `apply`: its new heights follow the tip one by one.  `gap`: some lack.  A block of a
    known height with another hash is a fork, which is judged as a reorganisation.
    """
    tip = blocks.agg(F.max("block_index").cast("bigint").alias("tip"))
    known = blocks.select("block_index", *[F.col(c).alias(f"__{c}") for c in fields])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__{c}")) & F.col(c).isNotNull() for c in fields])
    held = known.withColumn("__held", F.lit(True))
    joined = shown.join(held, "block_index", "left")
    fork = F.min(F.when(F.col("__held") & differs, F.col("block_index"))).alias("fork_block")
    per = joined.withColumn("tip", tip.scalar())
    new = F.when(F.col("tip").isNull() | (F.col("block_index") > F.col("tip")), F.col("block_index"))
    per = per.groupBy("batch").agg(fork, F.first("tip").alias("tip"), F.min(new).alias("low"), F.max(new).alias("high"), F.countDistinct(new).alias("n"))
    lacks = F.col("high") - F.coalesce(F.col("tip"), F.col("low") - 1) - F.col("n")
    depth = F.col("tip") - F.col("fork_block") + 1
    verdict = (F.when(F.col("fork_block").isNotNull(), F.when(depth > max_depth, "halt: too deep").otherwise("rollback"))
               .when(F.col("low").isNull(), "skip").when(lacks > 0, "gap").otherwise("apply"))
    return per.select("batch", verdict.alias("verdict"), F.col("fork_block").cast("bigint").alias("fork_block"),
                      F.coalesce(lacks, F.lit(0)).cast("bigint").alias("n_missing"))


def heartbeat_status(beats: DataFrame, roster: DataFrame, now: int, ttl: int, source_height: int | None) -> DataFrame:
    """Latest beat per validator with its lag: `stale` after the TTL, dropped after a further TTL
    unless on the roster, `absent` for roster members never seen."""
    last = beats.groupBy("validator_id").agg(
        F.max_by(F.struct("applied_height", "seen_at"), F.struct("seen_at", "applied_height")).alias("l"))
    seen = last.select("validator_id", F.col("l.applied_height").alias("applied_height"), F.col("l.seen_at").alias("seen_at"))
    listed = roster.select("validator_id", F.lit(True).alias("on_roster")).distinct()
    joined = seen.join(listed, "validator_id", "full_outer").withColumn(
        "on_roster", F.coalesce("on_roster", F.lit(False)))
    age = F.lit(now) - F.col("seen_at")
    lag = lag_blocks(F.lit(source_height).cast("bigint"), F.col("applied_height"))
    status = (F.when(F.col("seen_at").isNull(), "absent").when(age > ttl, "stale")
              .when(lag.isNull(), "unknown").otherwise("known"))
    return joined.where(F.col("on_roster") | (age <= 2 * ttl)).select(
        "validator_id", "applied_height", "seen_at", lag.alias("lag_blocks"), status.alias("status"), "on_roster")


def heartbeat_summary(status: DataFrame) -> DataFrame:
    """Live total, roster size and beats whose lag is unknown."""
    seen = F.col("status") != "absent"
    return status.agg(
        F.count_if(seen & (F.col("status") != "stale")).alias("total"),
        F.count_if("on_roster").alias("expected_total"),
        F.count_if(seen & F.col("lag_blocks").isNull()).alias("unknown_count"),
        F.max("lag_blocks").alias("max_lag"))


def replica_lag(sent: DataFrame, applied: DataFrame, now: int, stale_after: int) -> DataFrame:
    """Last height sent to and applied by each subscriber, with staleness."""
    s = sent.groupBy("subscriber").agg(F.max("block_index").alias("last_sent"))
    a = applied.groupBy("subscriber").agg(
        F.max("block_index").alias("last_applied"), F.max("seen_at").alias("seen_at"))
    stale = F.coalesce(F.lit(now) - F.col("seen_at") > stale_after, F.lit(True))
    return s.join(a, "subscriber", "full_outer").select(
        "subscriber", "last_sent", "last_applied", stale.alias("stale"),
        lag_blocks(F.col("last_sent"), F.col("last_applied"), stale).alias("lag_blocks"))
