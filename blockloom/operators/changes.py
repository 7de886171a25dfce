"""Change capture: rows a plain height range misses because they were changed in place or backdated."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.fixed_values import ARCHIVE_CHUNK_VERSION, ARCHIVE_HEAD_VERSIONS
from blockloom.operators.scan import in_window

CREDIT_IDENTITY = ["action_index", "address_id", "tick_id"]
REWARD_IDENTITY = ["source_id", "signing_pubkey_id", "reward_type", "round_reference"]


@dataclass(frozen=True)
class Stamp:
    """A row counts as changed when one of its stamp columns falls in the window."""
    table: str
    columns: tuple[str, ...]
    where: str | None = None
    delayed: bool = False  # stamps are written ahead by the activation delay


@dataclass(frozen=True)
class Journal:
    """A row counts as changed when a journal row in the window points at it."""
    table: str
    journal: str


# --- Fixed values: mutation classes of the stock schema ----------------------------------------
STAMPS = (
    Stamp("stakes", ("deactivation_block",), delayed=True),
    Stamp("delegations", ("deactivation_block",), delayed=True),
    Stamp("contract_stakes", ("deactivation_block",), delayed=True),
    Stamp("contract_delegations", ("deactivation_block",), delayed=True),
    Stamp("attests", ("resolved_block",), where="version = 0"),
    Stamp("xcalls", ("resolved_block",), where="version = 0"),
    Stamp("polls", ("resolved_block",)),
    Stamp("polls", ("callback_due_block",), where="callback_execute_action_index is not null"),
    Stamp("unstakes", ("cooldown_end_block",)),
    Stamp("contract_unstakes", ("cooldown_end_block",)),
    Stamp("bet_feeds", ("closed_block", "terminal_block")),
    Stamp("bets", ("settled_block",)),
)
JOURNALS = (
    Journal("contract_stakes", "contract_slash_debits"),
    Journal("contract_unstakes", "contract_slash_debits"),
    Journal("stakes", "capability_slash_debits"),
    Journal("unstakes", "capability_slash_debits"),
    Journal("contract_stakes", "contract_delegation_rotations"),
    Journal("contract_unstakes", "contract_delegation_rotations"),
)


def stamped(df: DataFrame, table: str, start: int, end: int, delay: int | None) -> Column:
    """Predicate over every stamp class of a table; classes with an unknown delay are left out."""
    test: Column = F.lit(False)
    for s in (s for s in STAMPS if s.table == table):
        if s.delayed and delay is None:
            continue
        if not set(s.columns) <= set(df.columns):
            continue
        hit = reduce(lambda a, b: a | b, [
            F.coalesce(in_window(c, start, end, delay if s.delayed else 0), F.lit(False)) for c in s.columns])
        test = test | (hit if s.where is None else hit & F.expr(s.where))
    return test


def journal_keys(tables: dict[str, DataFrame], table: str, start: int, end: int) -> DataFrame | None:
    parts = [
        tables[j.journal].where((F.col("target_table") == table) & in_window("block_index", start, end))
        .select(F.col("stake_action_index").alias("action_index"))
        for j in JOURNALS if j.table == table and j.journal in tables
    ]
    return reduce(DataFrame.union, parts).distinct() if parts else None


def archive_heads(anchors: DataFrame, statuses: DataFrame, start: int, end: int,
                  height: str = "block_index_doge", versions: tuple[int, ...] = ARCHIVE_HEAD_VERSIONS) -> DataFrame:
    """Invalidated archive heads whose valid chunk of the same batch landed in the window."""
    named = anchors.join(statuses.select(F.col("id").alias("status_id"), "status"), "status_id", "left")
    chunks = named.where((F.col("version") == ARCHIVE_CHUNK_VERSION) & (F.col("status") == "valid")
                         & in_window(height, start, end)).select("match_batch_seq")
    heads = named.where(F.col("version").isin(*versions) & (F.col("status") == "invalid_archive"))
    return heads.join(chunks, "match_batch_seq", "left_semi").select(*anchors.columns)


def touched_ticks(ledgers: list[DataFrame], actions: DataFrame, start: int, end: int) -> DataFrame:
    """Ticks with a ledger row in the window; each branch is reduced before the union."""
    window = actions.where(in_window("block_index", start, end)).select("action_index")
    parts = [df.where("tick_id is not null").join(window, "action_index", "left_semi").select("tick_id").distinct()
             for df in ledgers]
    return reduce(DataFrame.union, parts).distinct()


def updated_rows(tables: dict[str, DataFrame], start: int, end: int, delay: int | None,
                 statuses: DataFrame | None = None) -> dict[str, DataFrame]:
    """Current full state of every surviving row changed in the window, one row per action.

    A table absent from `tables` is skipped (older schemas lack some).  Stamp classes of a table
    share one scan; journal hits join in on the same pass.
    """
    out: dict[str, DataFrame] = {}
    for table in dict.fromkeys([s.table for s in STAMPS] + [j.table for j in JOURNALS]):
        df = tables.get(table)
        if df is None:
            continue
        test, keys = stamped(df, table, start, end, delay), journal_keys(tables, table, start, end)
        if keys is None:
            out[table] = df.where(test)
        else:
            marked = df.join(keys.withColumn("__hit", F.lit(True)), "action_index", "left")
            out[table] = marked.where(test | F.col("__hit").isNotNull()).select(*df.columns)
    if "anchor_actions" in tables and statuses is not None:
        out["anchor_actions"] = archive_heads(tables["anchor_actions"], statuses, start, end)
    if {"tokens", "actions", "credits", "debits", "escrows"} <= set(tables):
        ticks = touched_ticks([tables["credits"], tables["debits"], tables["escrows"]], tables["actions"], start, end)
        out["tokens"] = tables["tokens"].join(ticks, "tick_id", "left_semi")
    return out


def updated_rows_by_height(tables: dict[str, DataFrame], start: int, end: int, delay: int | None,
                           statuses: DataFrame | None = None, height: str = "__height") -> dict[str, DataFrame]:
    """As `updated_rows`, with the height at which each change happened: a row changed at several heights comes once
    for each of them, every time in its current state."""
    out: dict[str, DataFrame] = {}
    for table in dict.fromkeys([s.table for s in STAMPS] + [j.table for j in JOURNALS]):
        df = tables.get(table)
        if df is None:
            continue
        heights = []
        for s in (s for s in STAMPS if s.table == table and set(s.columns) <= set(df.columns)):
            if s.delayed and delay is None:
                continue
            for c in s.columns:
                at = (F.col(c) - F.lit(delay if s.delayed else 0)).cast("bigint")
                heights.append(F.when(in_window(at, start, end) & (F.expr(s.where) if s.where else F.lit(True)), at))
        journals = [j.journal for j in JOURNALS if j.table == table and j.journal in tables]
        parts = [df.withColumn(height, F.explode(F.array_distinct(F.filter(F.array(*heights), lambda h: h.isNotNull()))))] if heights else []
        for journal in journals:
            hits = tables[journal].where((F.col("target_table") == table) & in_window("block_index", start, end)).select(
                F.col("stake_action_index").alias("action_index"), F.col("block_index").cast("bigint").alias(height)).distinct()
            parts.append(df.join(hits, "action_index").select(*df.columns, height))
        if parts:
            both = reduce(DataFrame.unionByName, parts)
            out[table] = both if len(parts) == 1 else both.dropDuplicates(["action_index", height])
    if "anchor_actions" in tables and statuses is not None:
        anchors = tables["anchor_actions"]
        valid = anchors.join(statuses.where("status = 'valid'").select(F.col("id").alias("status_id")), "status_id", "left_semi")
        chunks = valid.where((F.col("version") == ARCHIVE_CHUNK_VERSION) & in_window("block_index_doge", start, end)).select(
            "match_batch_seq", F.col("block_index_doge").cast("bigint").alias(height)).distinct()
        out["anchor_actions"] = archive_heads(anchors, statuses, start, end).join(chunks, "match_batch_seq").select(*anchors.columns, height)
    if {"tokens", "actions", "credits", "debits", "escrows"} <= set(tables):
        window = tables["actions"].where(in_window("block_index", start, end)).select("action_index", F.col("block_index").alias(height))
        ticks = reduce(DataFrame.union, [tables[t].where("tick_id is not null").join(window, "action_index").select("tick_id", height).distinct()
                                         for t in ("credits", "debits", "escrows")]).distinct()
        out["tokens"] = tables["tokens"].join(ticks, "tick_id").select(*tables["tokens"].columns, height)
    return out


def _one_per_identity(df: DataFrame, identity: list[str], rank: Column | None = None) -> DataFrame:
    """The greatest row per identity: by `rank` where given, then column by column."""
    rest = [c for c in df.columns if c not in identity]
    first = [] if rank is None else [rank.alias("__rank")]
    kept = df.groupBy(*identity).agg(F.max(F.struct(*first, *rest)).alias("__r"))
    return kept.select(*[F.col(f"__r.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def matured_credit_rows(credits: DataFrame, unstakes: DataFrame, contract_unstakes: DataFrame, tickers: DataFrame,
                        statuses: DataFrame, gas_tick: str, window: Column) -> DataFrame:
    """Refund credits of completed cooldowns selected by `window` over the unstake row.

    Capability refunds pay the gas tick; contract refunds pay the stake's own tick.
    """
    done = statuses.where("status = 'completed'").select(F.col("id").alias("status_id"))
    plain = unstakes.where(window).join(done, "status_id", "left_semi").select(
        "action_index", F.col("source_id").alias("address_id"))
    gas = tickers.where(F.col("tick") == gas_tick).select(F.col("id").alias("tick_id"))
    by_gas = credits.join(gas, "tick_id", "left_semi").join(plain, ["action_index", "address_id"], "left_semi")
    bound = contract_unstakes.where(window).join(done, "status_id", "left_semi").select(
        "action_index", F.col("source_id").alias("address_id"), "tick_id")
    by_tick = credits.join(bound, CREDIT_IDENTITY, "left_semi")
    return by_gas.select(*credits.columns).unionByName(by_tick.select(*credits.columns))


def matured_credits(credits: DataFrame, unstakes: DataFrame, contract_unstakes: DataFrame, tickers: DataFrame,
                    statuses: DataFrame, gas_tick: str, start: int, end: int) -> DataFrame:
    """Backdated refund credits by maturity height, one per (action, address, tick)."""
    rows = matured_credit_rows(credits, unstakes, contract_unstakes, tickers, statuses, gas_tick,
                               in_window("cooldown_end_block", start, end))
    return _one_per_identity(rows.dropna(subset=CREDIT_IDENTITY), CREDIT_IDENTITY)


def redriven_rewards(rewards: DataFrame, pending: DataFrame, pubkeys: DataFrame, start: int, end: int) -> DataFrame:
    """Rewards re-applied in the window for an earlier earn height."""
    p = pending.where((F.col("applied") == 1) & in_window("applied_block", start, end)).select(
        "source_id", "reward_type", F.col("round_reference").alias("__round"), "amount", "block_index",
        F.col("validator_pubkey").alias("pubkey"), "applied_block").distinct()
    named = rewards.join(pubkeys.select(F.col("id").alias("signing_pubkey_id"), "pubkey"), "signing_pubkey_id")
    hit = named.join(p, ["source_id", "reward_type", "amount", "block_index", "pubkey"]).where(
        F.col("round_reference").eqNullSafe(F.col("__round")) & (F.col("block_index") < F.col("applied_block")))
    return _one_per_identity(hit.select(*rewards.columns), REWARD_IDENTITY, _reward_rank())


def derived_rewards(rewards: DataFrame, start: int, end: int) -> DataFrame:
    """Rewards derived in the window for an earlier earn height."""
    late = rewards.where(in_window("derive_block_index", start, end)
                         & (F.col("block_index") < F.col("derive_block_index")))
    return _one_per_identity(late.dropna(subset=["source_id", "signing_pubkey_id"]), REWARD_IDENTITY, _reward_rank())


def _reward_rank() -> Column:
    """Of several rewards with one identity the greatest `amount|height` text stands.  The mark after the amount counts:
    it sorts above digits, so "5" beats "50" although "50" is the greater text."""
    return F.concat("amount", F.lit("|"), F.lpad(F.col("block_index").cast("string"), 9, "0"))
