"""Stake weights, effective key sets, caps and quorum verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.fixed_values import STAKE_MAX_KEYS_PER_SOURCE, STAKE_MAX_SOURCES
from blockloom.functions import decimals
from blockloom.operators.scan import bad_weight, status_id_rows

WEIGHT = "decimal(30,8)"


def _valid(df: DataFrame, statuses: DataFrame) -> DataFrame:
    valid = status_id_rows(statuses, "valid").select(F.col("id").alias("status_id"))
    return df.join(valid, "status_id", "left_semi")


def _active(height: int) -> Column:
    return (F.col("activation_block") <= height) & (
        F.col("deactivation_block").isNull() | (F.col("deactivation_block") > height))


def source_weights(stakes: DataFrame, statuses: DataFrame, height: int, floor: str | int,
                   slash_debits: DataFrame | None = None) -> DataFrame:
    """Active stake per source at a height, kept at or above the floor.

    With a slash log the weight is the one that held at the height: cuts logged later are
    added back (only cuts on `stakes` rows).
    """
    active = _valid(stakes, statuses).where(_active(height)).select("action_index", "source_id", "amount")
    amount = F.col("amount").cast(WEIGHT)
    if slash_debits is not None:
        later = slash_debits.where((F.col("target_table") == "stakes") & (F.col("block_index") > height)).groupBy(
            F.col("stake_action_index").alias("action_index")).agg(F.sum(F.col("amount").cast(WEIGHT)).alias("cut"))
        active = active.join(later, "action_index", "left")
        amount = amount + F.coalesce(F.col("cut").cast(WEIGHT), F.lit(0).cast(WEIGHT))
    totals = active.groupBy("source_id").agg(F.sum(amount).alias("weight"))
    return totals.where(F.col("weight") >= F.lit(str(floor)).cast(WEIGHT))


def effective_keys(stakes: DataFrame, delegations: DataFrame, revocations: DataFrame, slash_events: DataFrame,
                   statuses: DataFrame, height: int) -> DataFrame:
    """(source, key) pairs that may sign: own stake keys not revoked by a newer revocation, plus
    delegated keys, both minus keys slashed up to the height."""
    pair = ["source_id", "signing_pubkey_id"]
    revoked = _valid(revocations, statuses).where(F.col("deactivation_block") <= height)
    newest = revoked.groupBy(*pair).agg(F.max("action_index").alias("revoked_at"))
    own = _valid(stakes, statuses).where(_active(height)).join(newest, pair, "left").where(
        F.col("revoked_at").isNull() | (F.col("revoked_at") <= F.col("action_index"))).select(*pair)
    lent = _valid(delegations, statuses).where(_active(height)).select(*pair)
    slashed = slash_events.where(F.col("block_index") <= height).select("signing_pubkey_id")
    return own.unionByName(lent).distinct().join(slashed, "signing_pubkey_id", "left_anti").select(*pair)


def stake_weights(stakes: DataFrame, delegations: DataFrame, revocations: DataFrame, slash_events: DataFrame,
                  statuses: DataFrame, addresses: DataFrame, pubkeys: DataFrame, height: int,
                  floor: str | int, slash_debits: DataFrame | None = None) -> DataFrame:
    """(pubkey, source, weight) of the validator set at a height."""
    totals = source_weights(stakes, statuses, height, floor, slash_debits)
    keys = effective_keys(stakes, delegations, revocations, slash_events, statuses, height)
    sources = addresses.select(F.col("id").alias("source_id"), F.col("address").alias("source"))
    names = pubkeys.select(F.col("id").alias("signing_pubkey_id"), "pubkey")
    return (totals.join(keys, "source_id").join(sources, "source_id").join(names, "signing_pubkey_id")
            .select("pubkey", "source", "weight"))


def cap_sources(weights: DataFrame, max_sources: int = STAKE_MAX_SOURCES,
                max_keys: int = STAKE_MAX_KEYS_PER_SOURCE) -> DataFrame:
    """First `max_sources` sources by name and first `max_keys` keys of each; `truncated` says that
    a further source existed (then any quorum over the set fails closed).

    The cap is the protocol's own rule.  Sources are ranked from a top-k, so at most
    max_sources + 1 of them ever meet in one task; keys are ranked inside their source.
    """
    top = weights.select("source").distinct().orderBy("source").limit(max_sources + 1)
    ranked = top.withColumn("source_rank", F.row_number().over(Window.orderBy("source")))
    ranked = ranked.withColumn("truncated", F.max("source_rank").over(Window.partitionBy()) > max_sources)
    keys = Window.partitionBy("source").orderBy("pubkey")
    return (weights.join(ranked.where(F.col("source_rank") <= max_sources), "source")
            .withColumn("key_rank", F.row_number().over(keys)).where(F.col("key_rank") <= max_keys)
            .select("pubkey", "source", "weight", "source_rank", "key_rank", "truncated"))


def cap_rows(weights: DataFrame, limit: int) -> DataFrame:
    """Older rule: first `limit` rows by (source, pubkey); reaching the limit means truncated."""
    capped = weights.orderBy("source", "pubkey").limit(limit)
    return capped.withColumn("truncated", F.count("*").over(Window.partitionBy()) >= limit)


def stake_quorum(members: DataFrame, signers: DataFrame, group: list[str]) -> DataFrame:
    """Stake-weighted verdict per group: 3 x signing stake > 2 x total stake, each source once, exactly.

    `members`: group, pubkey, source, weight, truncated.  `signers`: group, pubkey.  Any bad entry,
    a weight that isn't plain decimal text of at most 54 whole and 18 fraction digits, or a
    truncated set voids its group.  Members are reduced to one row per source before the group is
    summed, so a group with very many keys pre-aggregates.  Stakes come out as exact decimal text.
    """
    plain = F.coalesce(F.trim(F.col("weight").cast("string")).rlike(decimals.AMOUNT_PATTERN), F.lit(False))
    keyed = members.withColumns({
        "__pk": F.lower(F.col("pubkey").cast("string")),
        "__bad": bad_weight(F.col("source"), F.col("weight")) | ~plain | F.coalesce(F.col("truncated"), F.lit(False)),
    })
    signed = signers.select(*group, F.lower(F.col("pubkey").cast("string")).alias("__pk")).distinct()
    marked = keyed.join(signed.withColumn("__signed", F.lit(True)), [*group, "__pk"], "left")
    weight = F.when(~F.col("__bad"), decimals.sortable(F.col("weight")))
    per_source = marked.groupBy(*group, "source").agg(
        F.max(weight).alias("w"), F.bool_or(F.col("__signed").isNotNull()).alias("signed"),
        F.bool_or("__bad").alias("bad"))
    both = decimals.with_limbs(per_source.withColumn("v", F.when(F.col("signed"), F.col("w"))), "w", "__t")
    both = decimals.with_limbs(both, "v", "__s")
    totals = both.groupBy(*group).agg(*decimals.limb_sums("__t"), *decimals.limb_sums("__s"), F.bool_or("bad").alias("bad"))
    settled = decimals.settle(decimals.settle(totals, "__t"), "__s")
    passed = ~F.col("bad") & decimals.is_nonzero("__t") & decimals.exceeds("__s", 3, "__t", 2)
    return settled.select(*group, decimals.minimal_text("__t").alias("total_stake"), decimals.minimal_text("__s").alias("signed_stake"),
                          F.coalesce(passed, F.lit(False)).alias("meets_quorum"))


def count_threshold(n: Column) -> Column:
    """Votes a set of n needs: the larger of 2*floor((n-1)/3)+1 and ceil((n+1)/2); one for n <= 1."""
    bft = F.floor((n - 1) / 3) * 2 + 1
    return F.when(n <= 1, F.lit(1)).otherwise(F.greatest(bft, F.ceil((n + 1) / 2))).cast("bigint")


def source_threshold(n: Column, configured: Column | None = None) -> Column:
    """Cross-source agreement threshold, default majority of the sources, clamped to the active ones."""
    wanted = F.floor(n / 2) + 1 if configured is None else configured
    return F.least(wanted, F.greatest(F.lit(1), n)).cast("bigint")


def count_quorum(members: DataFrame, signatures: DataFrame, group: list[str]) -> DataFrame:
    """Count verdict per group over distinct valid signers who are members.  `signatures`: group,
    pubkey, sig_valid."""
    keys = members.select(*group, F.lower("pubkey").alias("__pk")).distinct()
    valid = signatures.where("sig_valid").select(*group, F.lower("pubkey").alias("__pk")).distinct()
    votes = keys.join(valid.withColumn("__v", F.lit(1)), [*group, "__pk"], "left").groupBy(*group).agg(
        F.count("*").alias("n_members"), F.count("__v").alias("valid_signatures"))
    quorum = count_threshold(F.col("n_members"))
    return votes.withColumn("quorum", quorum).withColumn(
        "valid", (F.col("n_members") > 0) & (F.col("valid_signatures") >= F.col("quorum")))


def checkpoint_verdicts(checkpoints: DataFrame, members: DataFrame, signatures: DataFrame,
                        key: str = "checkpoint_seq") -> DataFrame:
    """Quorum verdict per checkpoint.  `checkpoints` carries `weighted` (regime of its snapshot
    height) and `commitment_missing`; both regimes are computed and the row's regime picked."""
    valid = signatures.where("sig_valid").select(key, "pubkey")
    counted = count_quorum(members, signatures, [key]).select(key, "valid_signatures", "quorum",
                                                             F.col("valid").alias("count_valid"))
    staked = stake_quorum(members, valid, [key]).select(key, "meets_quorum")
    picked = F.when(F.col("commitment_missing"), False).when(
        F.col("weighted"), F.coalesce("meets_quorum", F.lit(False))).otherwise(F.coalesce("count_valid", F.lit(False)))
    return (checkpoints.join(counted, key, "left").join(staked, key, "left")
            .withColumn("valid", picked).drop("meets_quorum", "count_valid"))


def anchor_verdicts(checkpoints: DataFrame, local_roots: DataFrame, tip: int, last_seq: int | None,
                    freshness: int, strict: bool = False) -> DataFrame:
    """What each checkpoint means for this replica; the first rule that applies decides.

    Needs `valid`; joins the locally recomputed roots by height.
    """
    local = local_roots.select("block_index", F.col("state_root").alias("__s"),
                               F.col("block_merkle_root").alias("__m"), F.lit(True).alias("__have"))
    joined = checkpoints.join(local, "block_index", "left")
    differs = (F.lower("state_root") != F.lower("__s")) | F.coalesce(
        F.lower("block_merkle_root") != F.lower("__m"), F.lit(False))
    stale = F.lit(tip) - F.col("block_index") > freshness
    regressed = F.lit(False) if last_seq is None else F.col("checkpoint_seq") < last_seq
    strict_halt = F.lit(strict and last_seq is not None)
    verdict = (
        F.when(F.col("state_root").isNull(), "no commitment")
        .when(regressed, "sequence regression")
        .when(stale & strict_halt, "halt: stale anchor")
        .when(F.col("block_index") > tip, "ahead of replica")
        .when(~F.col("valid"), "halt: quorum invalid")
        .when(F.col("__have").isNull(), "height not recomputed")
        .when(F.coalesce(differs, F.lit(True)), "halt: root mismatch")
        .otherwise("anchored")
    )
    return joined.withColumns({"stale": stale, "verdict": verdict}).drop("__s", "__m", "__have")


def follow_forward(checkpoints: DataFrame, seed_height: int, tip: int) -> DataFrame:
    """Trusted prefix of a checkpoint chain starting at a trusted seed.

    A checkpoint extends trust when it lies at or below the tip, its set is taken at or below
    the last trusted height, its quorum holds and its root matches (`valid`, `root_status` in
    match / mismatch / missing are inputs computed in parallel).  As long as the chain is
    unbroken the last trusted height is simply the previous checkpoint's height, so the first
    break per chain - a windowed minimum - decides everything after it; no step-by-step fold.
    """
    later = checkpoints.where(F.col("block_index") > seed_height)
    order = Window.partitionBy("chain").orderBy("block_index")
    prior = F.coalesce(F.lag("block_index").over(order), F.lit(seed_height).cast("bigint"))
    outcome = (
        F.when(F.col("block_index") > tip, "wait")
        .when(F.col("state_root").isNull(), "wait")
        .when(F.col("snapshot_block").isNull() | (F.col("snapshot_block") > F.col("__trusted")), "wait")
        .when(~F.col("valid"), "divergence")
        .when(F.col("root_status") == "missing", "wait")
        .when(F.col("root_status") == "mismatch", "divergence")
        .otherwise("ok")
    )
    judged = later.withColumn("__trusted", prior).withColumn("outcome", outcome)
    broken = F.min(F.when(F.col("outcome") != "ok", F.col("block_index"))).over(
        order.rowsBetween(Window.unboundedPreceding, 0))
    return judged.withColumn("__broken", broken).select(
        *checkpoints.columns,
        F.when(F.col("__broken").isNull(), "ok").when(F.col("__broken") == F.col("block_index"), F.col("outcome"))
         .otherwise("wait").alias("verdict"))
