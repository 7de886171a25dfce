"""Rollback of a whole table set to a height, as rewrites that all read the set before rollback.

Each step is a pure function of DataFrames.  Resets and restores read journals that later
deletes remove; since every step reads the original tables, order only matters where one
column is rewritten twice, and there the rewrites are chained explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom import registry as reg
from blockloom.fixed_values import ARCHIVE_CHUNK_VERSION, ARCHIVE_HEAD_VERSIONS
from blockloom.operators import aggregates as agg
from blockloom.operators import apply as ap
from blockloom.operators import changes, scan



def _null(df: DataFrame, column: str) -> Column:
    return F.lit(None).cast(df.schema[column].dataType)


def _reset(df: DataFrame, hit: Column, values: dict[str, Column | str | None]) -> DataFrame:
    hit = F.coalesce(hit, F.lit(False))
    cols = {}
    for name, value in values.items():
        if name in df.columns:
            new = _null(df, name) if value is None else F.lit(value) if isinstance(value, str) else value
            cols[name] = F.when(hit, new).otherwise(F.col(name))
    return df.withColumns(cols)


# ---- in-place resets ---------------------------------------------------------------------------
def reset_attests(df: DataFrame, height: int) -> DataFrame:
    hit = (F.col("version") == 0) & F.col("request_status").isin("fulfilled", "errored", "expired") & (
        F.col("resolved_block") >= height)
    return _reset(df, hit, {"request_status": "pending", "resolved_block": None})


def reset_xcalls(df: DataFrame, height: int) -> DataFrame:
    hit = (F.col("version") == 0) & F.col("request_status").isin("completed", "expired") & (
        F.col("resolved_block") >= height)
    return _reset(df, hit, {"request_status": "pending", "result_status": None, "result_payload": None,
                            "resolved_block": None, "callback_action_index": None})


POLL_RESULT_COLUMNS = ("winning_option", "total_weight", "total_voters", "quorum_met", "min_voters_met", "fail_reason",
                       "decided_early", "effective_close_block", "finalized_action_index", "resolved_block",
                       "deposit_resolved", "callback_execute_action_index", "callback_due_block")


def reset_polls(df: DataFrame, height: int) -> DataFrame:
    """Orphaned finalisation reopens the poll; a surviving one only loses an orphaned callback."""
    final = F.col("poll_status").isin("finalized", "failed_quorum")
    reopened = final & F.coalesce(F.col("resolved_block") >= height, F.lit(False))
    fired = final & ~reopened & (F.col("callback_due_block") >= height) & F.col("callback_execute_action_index").isNotNull()
    marked = df.withColumns({"__open": F.coalesce(reopened, F.lit(False)), "__fired": F.coalesce(fired, F.lit(False))})
    out = _reset(marked, F.col("__fired"), {"callback_execute_action_index": None})
    out = _reset(out, F.col("__open"), {c: None for c in POLL_RESULT_COLUMNS})
    return _reset(out, F.col("__open"), {"poll_status": "open"}).drop("__open", "__fired")


def _status_value(df: DataFrame, statuses: DataFrame, name: str, out: str) -> DataFrame:
    """Attach one status id as a column (a scalar subquery); an unknown name attaches NULL."""
    return df.withColumn(out, statuses.where(F.col("status") == name).agg(F.min("id")).scalar())


def reset_bet_feeds(df: DataFrame, statuses: DataFrame, height: int) -> DataFrame:
    """Terminal latch orphaned: back to closed when the closing survives, else to open; orphaned
    closing: back to open.  With a status name unknown that step does nothing."""
    both = _status_value(_status_value(df, statuses, "closed", "__closed"), statuses, "open", "__open")
    ended = F.coalesce(F.col("terminal_block") >= height, F.lit(False))
    shut = F.coalesce(F.col("closed_block") >= height, F.lit(False))
    was_closed = F.coalesce(F.col("closed_block") < height, F.lit(False))
    to_closed = ended & was_closed & F.col("__closed").isNotNull()
    to_open = ended & ~was_closed & F.col("__open").isNotNull()
    reopened = shut & F.col("__open").isNotNull()
    return both.withColumns({
        "feed_status_id": F.when(reopened | to_open, F.col("__open")).when(to_closed, F.col("__closed")).otherwise(F.col("feed_status_id")),
        "terminal_block": F.when(to_closed | to_open, _null(df, "terminal_block")).otherwise(F.col("terminal_block")),
        "closed_block": F.when(reopened, _null(df, "closed_block")).otherwise(F.col("closed_block")),
    }).select(*df.columns)


def reset_bets(df: DataFrame, statuses: DataFrame, height: int) -> DataFrame:
    both = _status_value(df, statuses, "open", "__open")
    hit = (F.col("settled_block") >= height) & F.col("__open").isNotNull()
    return _reset(both, hit, {"bet_status_id": F.col("__open"), "settled_block": None}).select(*df.columns)


def reset_archive_heads(df: DataFrame, statuses: DataFrame, first_action: int) -> DataFrame:
    """Surviving heads that an orphaned valid chunk invalidated go back to unverified."""
    named = df.join(statuses.select(F.col("id").alias("status_id"), "status"), "status_id", "left")
    chunks = named.where((F.col("version") == ARCHIVE_CHUNK_VERSION) & (F.col("status") == "valid") & (
        F.col("action_index") >= first_action)).select("match_batch_seq").distinct().withColumn("__chunk", F.lit(True))
    joined = _status_value(named.join(chunks, "match_batch_seq", "left"), statuses, "unverified", "__new")
    hit = F.col("version").isin(*ARCHIVE_HEAD_VERSIONS) & (F.col("status") == "invalid_archive") & (
        F.col("action_index") < first_action) & F.col("__chunk") & F.col("__new").isNotNull()
    return _reset(joined, hit, {"status_id": F.col("__new")}).select(*df.columns)


# ---- pre-image restores ------------------------------------------------------------------------
# --- Fixed values: tie order of each journal's pre-images (never the local id) -------------------
PREIMAGE_ORDER = {
    "contract_slash_debits": ("block_index", "execution_index", "slash_position"),
    "capability_slash_debits": ("block_index", "slash_action_index"),
    "contract_delegation_rotations": ("block_index", "delegation_action_index"),
}
PREIMAGE_VALUE = {
    "contract_slash_debits": ("prev_amount", "amount"),
    "capability_slash_debits": ("prev_amount", "amount"),
    "contract_delegation_rotations": ("prev_signing_pubkey_id", "signing_pubkey_id"),
}


def earliest_preimage(journal: DataFrame, target: str, height: int, value: str, order: tuple[str, ...]) -> DataFrame:
    """First orphaned pre-image per row: a minimum, not an anti self join."""
    orphaned = journal.where((F.col("target_table") == target) & (F.col("block_index") >= height))
    pick = F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order))
    return orphaned.groupBy(F.col("stake_action_index").alias("action_index")).agg(pick.alias("__p")).select(
        "action_index", F.col("__p.v").alias("__restored"), F.lit(True).alias("__hit"))


def restore_preimages(df: DataFrame, table: str, journals: dict[str, DataFrame], height: int) -> DataFrame:
    out = df
    for name, order in PREIMAGE_ORDER.items():
        if name not in journals:
            continue
        value, column = PREIMAGE_VALUE[name]
        if column not in df.columns:
            continue
        prior = earliest_preimage(journals[name], table, height, value, order)
        joined = out.join(prior, "action_index", "left")
        out = joined.withColumn(column, F.when(F.col("__hit"), F.col("__restored")).otherwise(F.col(column))).select(*df.columns)
    return out


def restore_rewards(rewards: DataFrame, reconcile_log: DataFrame, height: int) -> DataFrame:
    """Rewards taken away by an orphaned reconcile come back when both their heights survive."""
    lost = reconcile_log.where(
        (F.col("block_index") >= height) & (F.col("reward_block_index") < height)
        & (F.col("reward_derive_block_index").isNull() | (F.col("reward_derive_block_index") < height)))
    rows = lost.select("source_id", "signing_pubkey_id", "reward_type", "round_reference", "amount",
                       F.col("reward_block_index").alias("block_index"),
                       F.col("reward_derive_block_index").alias("derive_block_index"))
    # A NULL round never collides with another NULL under a unique key, so those rows all land.
    keyed = rows.where("round_reference is not null")
    return ap.insert(ap.insert_ignore(rewards, keyed, changes.REWARD_IDENTITY), rows.where("round_reference is null"))


def clear_stamps(df: DataFrame, writers: DataFrame, on: list[str], height: int, delay: int,
                 writer_height: str = "block_index") -> DataFrame:
    """NULL the deactivation stamps that an orphaned writer put there: same keys and exactly the
    writer's height plus the delay."""
    stamp = F.col(writer_height) + delay
    orphaned = writers.where(F.col(writer_height) >= height).select(
        *on, stamp.alias("deactivation_block"), F.lit(True).alias("__hit")).distinct()
    joined = df.join(orphaned, [*on, "deactivation_block"], "left")
    return _reset(joined, F.col("__hit"), {"deactivation_block": None}).select(*df.columns)


def clear_late_stamps(df: DataFrame, height: int, delay: int) -> DataFrame:
    return _reset(df, F.col("deactivation_block") >= height + delay, {"deactivation_block": None})


# ---- cooldown reversal -------------------------------------------------------------------------
def _matured_after(height: int) -> Column:
    return (F.col("cooldown_end_block") >= height) & (F.col("block_index") < height)


def drop_orphaned_refunds(credits: DataFrame, unstakes: DataFrame, contract_unstakes: DataFrame, tickers: DataFrame,
                          statuses: DataFrame, gas_tick: str, height: int) -> DataFrame:
    """Remove refund credits whose cooldown now matures again; runs even with no orphaned action."""
    known = statuses.where(F.col("status").isin("completed", "valid")).agg(F.countDistinct("status") == 2).scalar()
    done = statuses.where("status = 'completed'").select(F.col("id").alias("status_id"))
    plain = unstakes.where(_matured_after(height)).join(done, "status_id", "left_semi").select(
        "action_index", F.col("source_id").alias("address_id")).distinct()
    gas = tickers.where(F.col("tick") == gas_tick).select(F.col("id").alias("tick_id")).distinct()
    bound = contract_unstakes.where(_matured_after(height)).join(done, "status_id", "left_semi").select(
        "action_index", F.col("source_id").alias("address_id"), "tick_id").distinct()
    marked = (credits.join(gas.withColumn("__gas", F.lit(True)), "tick_id", "left")
              .join(plain.withColumn("__plain", F.lit(True)), ["action_index", "address_id"], "left")
              .join(bound.withColumn("__bound", F.lit(True)), changes.CREDIT_IDENTITY, "left"))
    refund = (F.col("__gas").isNotNull() & F.col("__plain").isNotNull()) | F.col("__bound").isNotNull()
    return marked.where(~(refund & known)).select(*credits.columns)


def reopen_cooldowns(df: DataFrame, statuses: DataFrame, height: int) -> DataFrame:
    both = _status_value(_status_value(df, statuses, "completed", "__done"), statuses, "valid", "__valid")
    hit = (F.col("status_id") == F.col("__done")) & F.col("__valid").isNotNull() & _matured_after(height)
    return _reset(both, hit, {"status_id": F.col("__valid")}).select(*df.columns)


# ---- deletes and sweeps ------------------------------------------------------------------------
def below(df: DataFrame, column: str, limit: int, keep_null: bool = True) -> DataFrame:
    """Rows a `DELETE ... WHERE column >= limit` leaves."""
    kept = F.col(column) < limit
    return df.where(F.col(column).isNull() | kept if keep_null else kept)


def keep_referenced(df: DataFrame, column: str, lookup: DataFrame) -> DataFrame:
    """Rows a `DELETE ... WHERE column NOT IN (lookup ids)` leaves: matched ids, and NULL ids unless
    the lookup is empty (then NOT IN is true for every row).  A NULL inside the lookup keeps all."""
    ids = lookup.select(F.col("id").alias(column)).where(F.col(column).isNotNull()).distinct()
    some = lookup.agg(F.count("*") > 0).scalar()
    unknown = lookup.agg(F.count_if(F.col("id").isNull()) > 0).scalar()
    marked = df.join(ids.withColumn("__hit", F.lit(True)), column, "left")
    keep = F.col("__hit").isNotNull() | unknown | (F.col(column).isNull() & some)
    return marked.where(keep).select(*df.columns)


def drop_dead_markets(markets: DataFrame, orders: DataFrame, matches: DataFrame, first_action: int) -> DataFrame:
    """Drop a market when a trade of its pair was orphaned and none survives, either orientation."""
    pair = [F.least("give_tick_id", "get_tick_id").alias("__a"), F.greatest("give_tick_id", "get_tick_id").alias("__b")]
    trades = orders.select("action_index", *pair, (F.col("give_tick_id") + F.col("get_tick_id")).alias("__s")).unionByName(
        matches.select("action_index", *pair, (F.col("give_tick_id") + F.col("get_tick_id")).alias("__s")))
    known = trades.where("__s is not null")
    fate = known.groupBy("__a", "__b").agg(
        F.bool_or(F.col("action_index") >= first_action).alias("hit"),
        F.bool_or(F.col("action_index") < first_action).alias("alive"))
    dead = fate.where("hit and not alive").select("__a", "__b")
    keyed = markets.withColumns({"__a": F.least("tick1_id", "tick2_id"), "__b": F.greatest("tick1_id", "tick2_id")})
    return keyed.join(dead, ["__a", "__b"], "left_anti").select(*markets.columns)


def drop_cross_chain(df: DataFrame, coin: str, first_action: int, sides: list[tuple[str, str]]) -> DataFrame:
    """Drop rows any of whose (chain, action) sides is an orphaned action of this chain."""
    gone: Column = F.lit(False)
    for chain, action in sides:
        gone = gone | F.coalesce((F.col(chain) == coin) & (F.col(action) >= first_action), F.lit(False))
    return df.where(~gone)


def cascade_emissions(emissions: DataFrame, executions: DataFrame, first_action: int) -> DataFrame:
    gone = executions.where(F.col("action_index") >= first_action).select(F.col("action_index").alias("execution_index"))
    return emissions.join(gone, "execution_index", "left_anti").select(*emissions.columns)


# ---- the whole rollback ------------------------------------------------------------------------
def rollback_indexer(tables: dict[str, DataFrame], height: int, coin: str | None = None, delay: int | None = None,
                     gas_tick: str | None = None, truncated: bool = False) -> dict[str, DataFrame]:
    """Table set as of just below `height`.  `truncated` marks a replica with a bootstrap base,
    whose partial order history cannot prove a market dead."""
    old, new = tables, dict(tables)
    # Scalar the reference protocol defines the cut with; one row of one aggregate.
    first = scan.first_action(old["actions"], height).first()[0] if "actions" in old else None
    statuses = old.get("index_statuses")
    have = lambda *names: all(n in old for n in names)

    if first is not None:
        if have("attests"):
            new["attests"] = reset_attests(new["attests"], height)
        if have("xcalls"):
            new["xcalls"] = reset_xcalls(new["xcalls"], height)
        if have("polls"):
            new["polls"] = reset_polls(new["polls"], height)
        if statuses is not None:
            if have("bet_feeds"):
                new["bet_feeds"] = reset_bet_feeds(new["bet_feeds"], statuses, height)
            if have("bets"):
                new["bets"] = reset_bets(new["bets"], statuses, height)
            if have("anchor_actions"):
                new["anchor_actions"] = reset_archive_heads(new["anchor_actions"], statuses, first)
        for t in ("stakes", "unstakes", "contract_stakes", "contract_unstakes"):
            if have(t):
                new[t] = restore_preimages(new[t], t, old, height)
        if have("validator_rewards", "anchor_reward_reconcile_log"):
            new["validator_rewards"] = restore_rewards(new["validator_rewards"], old["anchor_reward_reconcile_log"], height)
        if delay is not None:
            for t, writer, on in (("stakes", "unstakes", ["signing_pubkey_id"]),
                                  ("delegations", "delegations", ["source_id", "signing_pubkey_id"]),
                                  ("contract_stakes", "contract_unstakes", ["signing_pubkey_id", "target_contract_index", "tick_id"])):
                if have(t, writer):
                    new[t] = clear_stamps(new[t], old[writer], on, height, delay)
            if have("contract_delegations"):
                new["contract_delegations"] = clear_late_stamps(new["contract_delegations"], height, delay)
    if statuses is not None and gas_tick and have("credits", "unstakes", "contract_unstakes", "index_tickers"):
        new["credits"] = drop_orphaned_refunds(new["credits"], old["unstakes"], old["contract_unstakes"],
                                               old["index_tickers"], statuses, gas_tick, height)
    if statuses is not None:
        for t in ("unstakes", "contract_unstakes"):
            if have(t):
                new[t] = reopen_cooldowns(new[t], statuses, height)

    if first is not None:
        if have("contract_emissions", "contract_executions"):
            new["contract_emissions"] = cascade_emissions(new["contract_emissions"], old["contract_executions"], first)
        for t in reg.rollback_tables("action"):
            if have(t):
                new[t] = below(new[t], "action_index", first)
        families = [(new[o], new[s]) for o, s in (("orders", "order_statuses"), ("swaps", "swap_statuses"),
                                                  ("dispensers", "dispenser_statuses")) if have(o, s)]
        if families and statuses is not None and have("tokens", "index_tickers"):
            new["tokens"] = ap.rederive_escrow_gate(new["tokens"], families, statuses, old["index_tickers"])
    for t in reg.rollback_tables("block"):
        if have(t):
            new[t] = below(new[t], "block_index", height)
    if have("validator_rewards") and "derive_block_index" in old["validator_rewards"].columns:
        new["validator_rewards"] = below(new["validator_rewards"], "derive_block_index", height)
    for t in reg.rollback_tables("index"):
        if have(t):
            new[t] = below(new[t], "block_index", height)
    for table, column, lookup, on_replica in reg.ORPHAN_SWEEPS:
        if on_replica and have(table, lookup) and column in old[table].columns:
            new[table] = keep_referenced(new[table], column, new[lookup])
    if first is not None and not truncated and have("markets", "orders", "order_matches"):
        new["markets"] = drop_dead_markets(new["markets"], old["orders"], old["order_matches"], first)
    if coin == "BTC" and have("price_snapshots"):
        gone = (F.col("reference_chain") == "BTC") & (F.col("reference_block") >= height)
        new["price_snapshots"] = new["price_snapshots"].where(~F.coalesce(gone, F.lit(False)))
    if first is not None and coin is not None:
        for t, sides in (("oracle_prices", [("source_chain", "action_index")]),
                         ("cross_chain_calls", [("source_chain", "source_action_index")]),
                         ("cross_chain_matches", [("a_chain", "a_action_index"), ("b_chain", "b_action_index")])):
            if have(t):
                new[t] = drop_cross_chain(new[t], coin, first, sides)
    for t, column in (("sync_meta", "block_index"), ("merkle_epochs", "end_block"), ("attest_validator_stats", "last_updated_block")):
        if have(t):
            new[t] = below(new[t], column, height)
    if have("balances", "credits", "debits"):
        new["balances"] = agg.balances(new["credits"], new["debits"])
    if have("tokens", "credits", "debits", "escrows"):
        new["tokens"] = agg.token_supplies(new["tokens"], new["credits"], new["debits"], new["escrows"]).select(*old["tokens"].columns)
    return new


def rollback_decoder(tables: dict[str, DataFrame], height: int) -> dict[str, DataFrame]:
    """Drop rows of orphaned transactions, then transactions and blocks; lookups stay."""
    new = dict(tables)
    orphaned = tables["transactions"].where(F.col("block_index") >= height).select("tx_index")
    for t in reg.DECODER_TOPOLOGY["tx"]:
        if t in tables:
            new[t] = tables[t].join(orphaned, "tx_index", "left_anti").select(*tables[t].columns)
    for t in reg.DECODER_TOPOLOGY["block"]:
        if t in tables:
            new[t] = below(tables[t], "block_index", height)
    return new
