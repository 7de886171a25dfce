"""Write modes, derived-column upkeep, block apply and snapshot composition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom import registry as reg
from blockloom.fixed_values import OPEN_OFFER_STATUSES
from blockloom.functions.canon import encode_binary_json
from blockloom.operators import aggregates as agg
from blockloom.operators import changes, scan
from blockloom.sources.versions import Delta, without


# ---- write modes -------------------------------------------------------------------------------
HEIGHT = "__height"  # of the block an incoming row came with, where a batch spans several


def _one_per_key(incoming: DataFrame, keys: list[str], pick) -> DataFrame:
    rest = [c for c in incoming.columns if c not in (*keys, HEIGHT)]
    if not rest:
        return incoming.select(*keys).distinct()
    height = F.col(HEIGHT) if HEIGHT in incoming.columns else F.lit(0)
    one = incoming.groupBy(*keys).agg(pick(F.struct(height.alias("h"), *rest)).alias("__r"))
    picked = {c: F.col(f"__r.{c}").alias(c) for c in rest} | {k: F.col(k) for k in keys}
    return one.select(*[picked[c] for c in incoming.columns if c != HEIGHT])


def last_per_key(incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Of several incoming rows with one key the one of the highest block; of one block, the greatest row."""
    return _one_per_key(incoming, keys, F.max)


def first_per_key(incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Of several incoming rows with one key the one of the lowest block; of one block, the smallest row."""
    return _one_per_key(incoming, keys, F.min)


def insert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    incoming = incoming.drop(HEIGHT)
    return existing.unionByName(incoming, allowMissingColumns=True)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing keys win; of several incoming rows with one key the first to come lands."""
    return insert(existing, first_per_key(incoming, keys).join(existing.select(*keys), keys, "left_anti"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace existing ones of the same key, all columns; the last incoming one lands."""
    return insert(existing.join(incoming.select(*keys), keys, "left_anti"), last_per_key(incoming, keys))


def replace_by_key(existing: DataFrame, incoming: DataFrame, key: str, surrogate: str = "id") -> DataFrame:
    """Replace by natural key; the source's surrogate id is dropped, a missing key raises."""
    return upsert(existing.drop(surrogate), natural_rows(incoming, key, surrogate), [key])


def natural_rows(incoming: DataFrame, key: str, surrogate: str = "id") -> DataFrame:
    keyed = F.when(F.col(key).isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit(f"row without natural key {key}")))
    return incoming.drop(surrogate).where(keyed)


def mirror_delete(rewards: DataFrame, reconcile_log: DataFrame, start: int, end: int) -> DataFrame:
    """Drop rewards whose pre-image a reconcile log row in the window carries."""
    gone = reconcile_log.where(scan.in_window("block_index", start, end)).select(
        "source_id", "signing_pubkey_id", "reward_type", F.col("round_reference").alias("__round"))
    r, g = rewards.alias("r"), gone.alias("g")
    same = [F.col(f"r.{c}") == F.col(f"g.{c}") for c in ("source_id", "signing_pubkey_id", "reward_type")]
    same.append(F.col("r.round_reference").eqNullSafe(F.col("g.__round")))
    return r.join(g, same, "left_anti")


# ---- derived columns ---------------------------------------------------------------------------
def open_ownership_offers(families: list[tuple[DataFrame, DataFrame]], statuses: DataFrame) -> DataFrame:
    """(tick_id, action_index) of ownership offers whose latest status keeps them open.

    `families`: (offers, offer statuses) pairs.  Ties on the latest status row count as open when
    any of them is.
    """
    live = statuses.where(F.col("status").isin(*OPEN_OFFER_STATUSES)).select(
        F.col("id").alias("status_id"), F.lit(True).alias("__live"))
    parts = []
    for offers, log in families:
        flagged = log.join(live, "status_id", "left").select(
            F.col("offer_action_index").alias("offer"), "action_index", F.coalesce("__live", F.lit(False)).alias("live"))
        latest = flagged.groupBy("offer").agg(F.max(F.struct("action_index", "live")).alias("l")).where("l.live")
        owned = offers.where("give_ownership = 1").select("action_index", F.col("give_tick_id").alias("tick_id"))
        parts.append(owned.join(latest.select(F.col("offer").alias("action_index")), "action_index", "left_semi"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rederive_escrow_gate(tokens: DataFrame, families: list[tuple[DataFrame, DataFrame]], statuses: DataFrame,
                         tickers: DataFrame) -> DataFrame:
    """Gate of each token = lowest open ownership offer on its tick, else NULL.  A token whose tick
    is not in the lookup keeps what it has."""
    earliest = open_ownership_offers(families, statuses).groupBy("tick_id").agg(F.min("action_index").alias("__open"))
    known = tickers.select(F.col("id").alias("tick_id"), F.lit(True).alias("__known")).distinct()
    joined = tokens.join(earliest, "tick_id", "left").join(known, "tick_id", "left")
    gate = F.when(F.col("__known"), F.col("__open")).otherwise(F.col("escrow_action_index"))
    return joined.withColumn("escrow_action_index", gate).select(*tokens.columns)


# ---- apply -------------------------------------------------------------------------------------
KEYS = {"index_addresses": ["id"], "index_tickers": ["id"], "sync_meta": ["block_index"],
        "merkle_epochs": ["epoch"], "pubkeys": ["address_id"], "events": ["id"],
        "markets": ["tick1_id", "tick2_id"], "attest_validator_stats": ["validator_id"],
        "validator_rewards": changes.REWARD_IDENTITY}


def landing(table: str, existing: DataFrame, incoming: DataFrame) -> Delta:
    """How incoming rows change a table, by the way the registry says it is written."""
    mode = reg.write_mode(table)
    if mode == "ignore":
        keys = KEYS.get(table, ["id"])
        return Delta(without(first_per_key(incoming, keys), existing.select(*keys), keys))
    if mode == "upsert":
        return Delta(last_per_key(incoming, KEYS[table]), [(incoming.select(*KEYS[table]), KEYS[table])])
    if mode == "replace":
        key = reg.NATURAL_KEYS[table]
        rows = natural_rows(incoming, key)
        return Delta(last_per_key(rows, [key]), [(rows.select(key), [key])], ["id"] if "id" in existing.columns else [])
    return Delta(incoming.drop(HEIGHT))


def reward_changes(existing: DataFrame, incoming: DataFrame | None, log: DataFrame, window: tuple[int, int]) -> Delta:
    """Rewards of a batch, landed and mirror-deleted block by block: a reconcile log row takes away what landed up to
    its own block; a reward earned again in a later block lands."""
    keys = changes.REWARD_IDENTITY
    logged = log.where(scan.in_window("block_index", *window)).groupBy(*keys).agg(F.max("block_index").alias("__until"))
    gone = existing.select(*keys).distinct()
    gone = without(gone, without(gone, logged, keys), keys)  # those logged
    if incoming is None:
        return Delta(None, [(gone, keys)])
    r, g = incoming.alias("r"), logged.alias("g")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    landed = F.col(f"r.{HEIGHT}") > F.col("g.__until") if HEIGHT in incoming.columns else F.lit(False)
    live = r.join(g, [*same, ~F.coalesce(landed, F.lit(False))], "left_anti")
    stays = without(existing.select(*keys), gone, keys)
    return Delta(without(first_per_key(live, keys), stays, keys), [(gone, keys)])


def batch_changes(tables: dict[str, DataFrame], data: dict[str, DataFrame], updated: dict[str, DataFrame],
                  window: tuple[int, int] | None = None, statuses: DataFrame | None = None) -> dict[str, Delta]:
    """What landing new rows, upserting changed rows, mirroring reward deletes, re-deriving the gate and
    adding up the balances that the new ledger rows touch does to each table."""
    out: dict[str, Delta] = {}
    log_name, rewards = "anchor_reward_reconcile_log", "validator_rewards"
    for name, rows in data.items():
        out[name] = landing(name, tables[name], rows) if name in tables else Delta(rows.drop(HEIGHT))
    if window and rewards in tables and (log_name in tables or log_name in out):
        log = out[log_name].on(tables[log_name]) if log_name in out and log_name in tables else tables[log_name] if log_name in tables else out[log_name].rows
        out[rewards] = reward_changes(tables[rewards], data.get(rewards), log, window)
    for name, rows in updated.items():
        gone = [(rows.select("action_index"), ["action_index"])]
        out[name] = out.get(name, Delta()).then(last_per_key(rows, ["action_index"]), gone) if name in tables else Delta(rows.drop(HEIGHT))

    def now(name: str) -> DataFrame:
        return out[name].on(tables[name]) if name in out and name in tables else tables[name] if name in tables else out[name].rows

    have = set(tables) | set(out)
    moved = (set(data) | set(updated)) & set(reg.ESCROW_TRIGGER_TABLES)
    families = [(now(o), now(s)) for o, s in (("orders", "order_statuses"), ("swaps", "swap_statuses"),
                                              ("dispensers", "dispenser_statuses")) if {o, s} <= have]
    if moved and families and statuses is not None and {"tokens", "index_tickers"} <= have:
        before = now("tokens")
        after = rederive_escrow_gate(before, families, statuses, now("index_tickers"))
        ticks = after.exceptAll(before).select("tick_id").distinct()
        out["tokens"] = out.get("tokens", Delta()).then(after.join(ticks, "tick_id", "left_semi").select(*before.columns), [(ticks, ["tick_id"])])
    ledger_news = [data[t] for t in ("credits", "debits") if t in data]
    if ledger_news and "balances" in tables:
        touched = agg.touched_keys(ledger_news, agg.PAIR)
        news = {t: data[t] if t in data else ledger_news[0].limit(0) for t in ("credits", "debits")}
        out["balances"] = Delta(agg.balances_moved(tables["balances"], news["credits"], news["debits"], touched), [(touched, agg.PAIR)])
    return out


def apply_changes(tables: dict[str, DataFrame], data: dict[str, DataFrame], updated: dict[str, DataFrame],
                  window: tuple[int, int] | None = None, statuses: DataFrame | None = None) -> dict[str, DataFrame]:
    """Next table set after `batch_changes`."""
    moved = batch_changes(tables, data, updated, window, statuses)
    return {**tables, **{n: d.on(tables[n]) if n in tables else d.rows for n, d in moved.items()}}


# ---- snapshots ---------------------------------------------------------------------------------
def incremental_snapshot(tables: dict[str, DataFrame], since: int, tip: int, delay: int | None, gas_tick: str,
                         statuses: DataFrame, skip_lookups: bool = False) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(data, updated rows) that bring a replica whose next height is `since` up to `tip`.

    Block tables by height, action tables by their action's height, emissions through their
    execution, lookups and derived tables whole; backdated credits and rewards are merged in.
    """
    actions = tables["actions"]
    data: dict[str, DataFrame] = {}
    for entry in reg.INDEXER:
        df = tables.get(entry.table)
        if df is None or entry.replication in ("local", "hub-mirror", "follower-derived"):
            continue
        if entry.table == "contract_emissions":
            data[entry.table] = scan.emission_scan(df, tables["contract_executions"], actions, since, tip)
        elif entry.table == "actions" or entry.replication in ("stream:block", "stream:special"):
            data[entry.table] = scan.block_scan(df, since, tip)
        elif entry.replication == "stream:action":
            data[entry.table] = scan.action_scan(df, actions, since, tip)
        elif entry.replication == "stream:index":
            if not skip_lookups:
                data[entry.table] = df
        else:
            data[entry.table] = df
    if {"unstakes", "contract_unstakes", "credits", "index_tickers"} <= set(tables):
        late = changes.matured_credits(tables["credits"], tables["unstakes"], tables["contract_unstakes"],
                                       tables["index_tickers"], statuses, gas_tick, since, tip)
        data["credits"] = scan.merge_side_channel(data["credits"], late, changes.CREDIT_IDENTITY)
    if "validator_rewards" in tables:
        late = changes.derived_rewards(tables["validator_rewards"], since, tip)
        if {"recovery_pending_rewards", "index_pubkeys"} <= set(tables):
            late = late.unionByName(changes.redriven_rewards(
                tables["validator_rewards"], tables["recovery_pending_rewards"], tables["index_pubkeys"], since, tip))
        data["validator_rewards"] = scan.merge_side_channel(data["validator_rewards"], late, changes.REWARD_IDENTITY)
    return data, changes.updated_rows(tables, since, tip, delay, statuses)


def window_rows(tables: dict[str, DataFrame], start: int, end: int, delay: int | None, gas_tick: str,
                statuses: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(data, updated rows) of every block of a window, each row with the height it belongs to, in one plan for all heights.

    Rows of actions take their action's height, emissions their execution's; a lookup row comes at the first height
    that points at it; backdated credits and rewards come at the height that completed them.  Of lookups over-fetch
    is harmless: any `*_id` value counts for every lookup.
    """
    at = F.col("block_index").cast("bigint").alias(HEIGHT)
    own = tables["actions"].where(scan.in_window("block_index", start, end)).select("action_index", at)
    data: dict[str, DataFrame] = {}
    for entry in reg.INDEXER:
        df = tables.get(entry.table)
        if df is None or not entry.replication.startswith("stream:") or entry.replication == "stream:index":
            continue
        if entry.table == "contract_emissions":
            runs = tables["contract_executions"].join(own, "action_index").select(F.col("action_index").alias("execution_index"), HEIGHT)
            data[entry.table] = df.join(runs, "execution_index").select("execution_index", "emitted_action", "action_index", "position", HEIGHT)
        elif entry.table == "actions" or entry.replication in ("stream:block", "stream:special"):
            data[entry.table] = scan.block_scan(df, start, end).select("*", at)
        else:
            data[entry.table] = df.join(own, "action_index").select(*df.columns, HEIGHT)
    if {"unstakes", "contract_unstakes", "credits", "index_tickers"} <= set(tables):
        late = changes.matured_credits(tables["credits"], tables["unstakes"], tables["contract_unstakes"],
                                       tables["index_tickers"], statuses, gas_tick, start, end)
        ended = [tables[t].where(scan.in_window("cooldown_end_block", start, end)).select(
            "action_index", F.col("source_id").alias("address_id"), F.col("cooldown_end_block").cast("bigint").alias(HEIGHT)) for t in ("unstakes", "contract_unstakes")]
        when = ended[0].unionByName(ended[1]).groupBy("action_index", "address_id").agg(F.min(HEIGHT).alias(HEIGHT))
        late = late.join(when, ["action_index", "address_id"]).select(*late.columns, HEIGHT)
        data["credits"] = scan.merge_side_channel(data["credits"], late, changes.CREDIT_IDENTITY)
    if "validator_rewards" in tables:
        rewards = tables["validator_rewards"]
        late = changes.derived_rewards(rewards, start, end)
        late = late.withColumn(HEIGHT, F.col("derive_block_index").cast("bigint"))
        if {"recovery_pending_rewards", "index_pubkeys"} <= set(tables):
            again = changes.redriven_rewards(rewards, tables["recovery_pending_rewards"], tables["index_pubkeys"], start, end)
            done = tables["recovery_pending_rewards"].where((F.col("applied") == 1) & scan.in_window("applied_block", start, end)).groupBy(
                "source_id", "reward_type", "round_reference").agg(F.min("applied_block").cast("bigint").alias("__done"))
            a, d = again.alias("a"), done.alias("d")
            same = [F.col(f"a.{c}").eqNullSafe(F.col(f"d.{c}")) for c in ("source_id", "reward_type", "round_reference")]
            late = late.unionByName(a.join(d, same).select(*[F.col(f"a.{c}") for c in again.columns], F.col("d.__done").alias(HEIGHT)))
        data["validator_rewards"] = scan.merge_side_channel(data["validator_rewards"], late, changes.REWARD_IDENTITY)
    lookups = [e.table for e in reg.INDEXER if e.replication == "stream:index" and e.table in tables]
    if lookups:
        ids = scan.first_references(list(data.values()), HEIGHT)
        for name in lookups:
            data[name] = tables[name].join(ids, "id").select(*tables[name].columns, HEIGHT)
    return data, changes.updated_rows_by_height(tables, start, end, delay, statuses, HEIGHT)


def window_payload(tables: dict[str, DataFrame], start: int, end: int, delay: int | None, gas_tick: str, statuses: DataFrame,
                   view_tip: int | None = None) -> DataFrame:
    """Payload of every block of a window as rows block_index, table, channel, row_json, ready for `apply_batch`.

    Rows show the state at the tables' version (`view_tip`, else the window's end), so blocks below it ship no
    state hash or state root; their other hashes hold at any time.
    """
    data, updated = window_rows(tables, start, end, delay, gas_tick, statuses)
    if "blocks" in data:
        data["blocks"] = withhold_burst_hashes(data["blocks"], end if view_tip is None else view_tip)
    parts = [encode_binary_json(df, also=[HEIGHT]).select(
        F.col(HEIGHT).alias("block_index"), F.lit(name).alias("table"), F.lit(channel).alias("channel"), "row_json")
        for channel, frames in (("data", data), ("updated", updated)) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def block_payload(data: dict[str, DataFrame], updated: dict[str, DataFrame]) -> DataFrame:
    """Change rows in exchange form: table, channel (data or updated) and the row as JSON."""
    parts = []
    for channel, frames in (("data", data), ("updated", updated)):
        for name, df in frames.items():
            parts.append(encode_binary_json(df).select(F.lit(name).alias("table"), F.lit(channel).alias("channel"), "row_json"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def withhold_burst_hashes(heads: DataFrame, view_tip: int) -> DataFrame:
    """Heights below the view's tip ship no state hash or root: those hold only right after their block."""
    at_tip = F.col("block_index") == view_tip
    return heads.withColumns({c: F.when(at_tip, F.col(c)) for c in ("state_hash", "state_root") if c in heads.columns})


def truncated_base(tip: int, depth: int) -> int:
    """Height a truncated bootstrap starts from."""
    return max(0, tip - depth)


def full_snapshot(tables: dict[str, DataFrame]) -> list[tuple[int, str, DataFrame]]:
    """Eligible tables in export order, lookups first."""
    hidden = set(reg.tables_where(lambda e: e.replication in ("local", "hub-mirror", "follower-derived")))
    eligible = [t for t in tables if t not in hidden and t not in reg.NEVER_EXPORTED]
    middle = sorted(t for t in eligible if t not in reg.PRIORITY_TABLES and t not in reg.TRAILING_TABLES)
    order = [t for t in reg.PRIORITY_TABLES if t in eligible] + middle + [t for t in reg.TRAILING_TABLES if t in eligible]
    return [(i, t, tables[t]) for i, t in enumerate(order)]


def apply_full_snapshot(local: dict[str, DataFrame], snapshot: dict[str, DataFrame], height: int) -> dict[str, DataFrame]:
    """Table set after a bootstrap: every exported table is the snapshot's, local-only tables stay,
    exported tables the snapshot lacks are dropped, and derived roots at or above the height go."""
    keep = set(reg.tables_where(lambda e: e.replication in ("local", "hub-mirror", "follower-derived"))) | set(reg.NEVER_EXPORTED)
    out = {t: df for t, df in local.items() if t in keep}
    out.update({t: df for t, df in snapshot.items() if t not in keep})
    if "state_tree_roots" in out:
        out["state_tree_roots"] = out["state_tree_roots"].where(F.col("block_index") < height)
    return out


def replace_table(tables: dict[str, DataFrame], name: str, rows: DataFrame) -> dict[str, DataFrame]:
    """Reconcile a table whose rows expire in place: the full set read at one version replaces it."""
    return {**tables, name: rows}


def reconcile_due(resumed: bool, catch_ups: int, every: int, elapsed_ms: int, max_interval_ms: int) -> bool:
    """Reconcile on the first catch-up after a resume, on every `every`-th one, or when overdue."""
    return resumed or (every > 0 and catch_ups % every == 0) or elapsed_ms >= max_interval_ms
