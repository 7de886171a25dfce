"""Table lifecycle registry: how every ledger table travels, rolls back and is committed.

The registry is an argument of the operators, so any ledger schema can bring its own rows.
`INDEXER` holds the stock schema.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "table string, owner string, replication string, rollback string, replica_rollback string, hash_classes string"


@dataclass(frozen=True)
class TableEntry:
    table: str
    replication: str
    rollback: str | None
    replica_rollback: str
    hash_classes: tuple[str, ...] = ()
    owner: str = "indexer"


# --- Fixed values: stock tables whose rows follow from hashed actions -------------------------
ACTION_DERIVED = """
addresses airdrops batches broadcasts callbacks coinpay_expires coinpay_obligations coinpay_statuses
coinpays destroys dispensers dispenser_cancels dispenser_closes dispenser_edits dispenser_expires
dispenser_statuses dispenses dividends fees files gated_files issues links lists list_edits list_items
list_items_invalid mappings_actions mappings_files messages mints orders order_cancels order_edits
order_expires order_matches order_statuses sends sleeps swaps swap_cancels swap_edits swap_expires
swap_matches swap_statuses cross_chain_settlements cross_chain_call_executions
cross_chain_call_callbacks sweeps stake_key_revocations reward_claims full_node_verifications
contract_permissions deploy_chunks prices token_controllers address_controllers bet_feed_statuses
bet_statuses bet_cancels bet_resolves votes poll_results vote_delegations
""".split()

# --- Fixed values: stock action tables with their own hash classes ----------------------------
ACTION_HASHED = {
    "actions": ("actions",),
    "credits": ("ledger", "state_hash"),
    "debits": ("ledger",),
    "escrows": ("ledger",),
    "contracts": ("contracts",),
    "contract_executions": ("contracts",),
    "deposits": ("contracts",),
    "withdrawals": ("contracts",),
    "stakes": ("state_hash", "state_commitment"),
    **{t: ("state_hash",) for t in (
        "xcalls tokens unstakes delegations contract_stakes contract_unstakes contract_delegations "
        "anchor_actions attests polls bet_feeds bets").split()},
}

# --- Fixed values: stock block tables ----------------------------------------------------------
BLOCK_TABLES = {
    "blocks": (), "transactions": (), "validator_rewards": (),
    "contract_state": ("contracts",), "escrow_leaf_journal": ("state_commitment",),
    "slash_events": (), "contract_slash_debits": (), "contract_delegation_rotations": (),
    "capability_slash_events": (), "capability_slash_debits": (), "anchor_reward_reconcile_log": (),
}

# --- Fixed values: stock lookups and the remaining single tables -------------------------------
HEIGHT_LOOKUPS = ("index_addresses", "index_tickers")
PLAIN_LOOKUPS = (
    "index_actions", "index_coins", "index_fiats", "index_memos", "index_mime_types",
    "index_pubkeys", "index_statuses", "index_transactions",
)
SINGLES = [
    ("pending_hub_pushes", "local", "action", "local", ()),
    ("state_tree_roots", "follower-derived", "block", "mirror", ("state_commitment",)),
    ("balances", "snapshot", "recomputed", "recomputed", ("state_commitment",)),
    ("markets", "snapshot", "recomputed", "special", ()),
    ("attest_validator_stats", "snapshot", "recomputed", "special", ()),
    ("contract_emissions", "stream:action", "special", "special", ("contracts",)),
    ("icons", "local", "special", "special", ()),
    ("pubkeys", "snapshot", "special", "special", ()),
    ("price_snapshots", "hub-mirror", "special", "special", ("quorum",)),
    ("events", "snapshot", "exempt", "exempt", ()),
    ("recovery_pending_rewards", "local", "exempt", "local", ()),
    ("cross_chain_call_rejections", "local", "exempt", "local", ()),
    ("push_generations", "snapshot", "exempt", "local", ()),
    ("cross_chain_matches", "hub-mirror", "exempt", "special", ("quorum",)),
    ("cross_chain_calls", "hub-mirror", "exempt", "special", ("quorum",)),
    ("oracle_prices", "hub-mirror", "exempt", "special", ()),
    ("capability_snapshots", "hub-mirror", "exempt", "exempt", ("quorum",)),
    ("state_checkpoints", "hub-mirror", "exempt", "exempt", ("quorum",)),
    ("anchor_reward_attestations", "hub-mirror", "exempt", "exempt", ()),
    ("state_tree_nodes", "snapshot", "exempt", "exempt", ("state_commitment",)),
]

# --- Fixed values: decoder topology, snapshot order, sweeps, parity exclusions -----------------
DECODER_TOPOLOGY = {
    "block": ("blocks", "transactions"),
    "tx": ("transaction_outputs",),
    "index": ("index_addresses", "index_transactions", "pubkeys", "events"),
    "special": ("dispensers",),
}
PRIORITY_TABLES = (
    "index_actions", "index_addresses", "index_coins", "index_fiats", "index_memos",
    "index_mime_types", "index_pubkeys", "index_statuses", "index_tickers",
    "index_transactions", "blocks", "transactions", "actions",
)
TRAILING_TABLES = ("balances", "sync_meta", "pubkeys")
NEVER_EXPORTED = ("mempool_transactions", "sync_halt", "sync_state", "merkle_reorgs")
PARITY_CARVE_OUTS = {"indexer": ("markets",), "decoder": ("dispensers",)}
DIGEST_DROPPED_COLUMNS = {
    "blocks": ("id",),
    "contract_emissions": ("id",),
    "contract_state": ("state_key_bin",),
    "sync_meta": ("id", "logged_at"),
}
INSERT_IGNORE_EXTRA = ("pubkeys", "events", "sync_meta", "merkle_epochs", "validator_rewards")
UPSERT_TABLES = ("markets", "attest_validator_stats")
NATURAL_KEYS = {"blocks": "block_index"}
ESCROW_TRIGGER_TABLES = (
    "orders", "order_statuses", "swaps", "swap_statuses", "dispensers", "dispenser_statuses", "tokens",
)
ORPHAN_SWEEPS = (  # (table, id column, lookup, swept on a replica)
    ("icons", "token_id", "tokens", True),
    ("balances", "address_id", "index_addresses", False),
    ("balances", "tick_id", "index_tickers", False),
    ("markets", "tick1_id", "index_tickers", True),
    ("markets", "tick2_id", "index_tickers", True),
    ("pubkeys", "address_id", "index_addresses", True),
)


def _stock() -> list[TableEntry]:
    rows = [TableEntry(t, "stream:action", "action", "mirror") for t in ACTION_DERIVED]
    rows += [TableEntry(t, "stream:action", "action", "mirror", c) for t, c in ACTION_HASHED.items()]
    rows += [TableEntry(t, "stream:block", "block", "mirror", c) for t, c in BLOCK_TABLES.items()]
    rows += [TableEntry(t, "stream:index", "index", "mirror", ("index_map",)) for t in HEIGHT_LOOKUPS]
    rows += [TableEntry(t, "stream:index", "lookup", "lookup") for t in PLAIN_LOOKUPS]
    rows += [TableEntry(*s) for s in SINGLES]
    rows.append(TableEntry("sync_meta", "stream:special", None, "special", owner="sync"))
    rows.append(TableEntry("merkle_epochs", "snapshot", None, "special", owner="sync"))
    return rows


INDEXER: list[TableEntry] = _stock()


def registry_frame(spark: SparkSession, entries: list[TableEntry] = INDEXER) -> DataFrame:
    rows = [tuple({**asdict(e), "hash_classes": ",".join(e.hash_classes)}[c.split()[0]]
                  for c in COLUMNS.split(", ")) for e in entries]
    return spark.createDataFrame(rows, COLUMNS)


def tables_where(test, entries: list[TableEntry] = INDEXER) -> list[str]:
    return [e.table for e in entries if test(e)]


def stream_scope(scope: str, entries: list[TableEntry] = INDEXER) -> list[str]:
    return tables_where(lambda e: e.replication == f"stream:{scope}", entries)


def replicated_tables(db_type: str = "indexer", entries: list[TableEntry] = INDEXER) -> list[str]:
    if db_type == "decoder":
        return [t for scope in DECODER_TOPOLOGY.values() for t in scope]
    return [t for s in ("block", "tx", "action", "index", "special") for t in stream_scope(s, entries)]


def rollback_tables(mode: str, replica: bool = True, entries: list[TableEntry] = INDEXER) -> list[str]:
    return tables_where(
        lambda e: e.rollback == mode and (not replica or e.replica_rollback == "mirror"), entries)


def tables_with_hash_class(name: str, entries: list[TableEntry] = INDEXER) -> list[str]:
    return tables_where(lambda e: name in e.hash_classes, entries)


def exact_parity_tables(entries: list[TableEntry] = INDEXER) -> list[str]:
    return tables_where(
        lambda e: e.replication.startswith("stream:") and e.replica_rollback == "mirror", entries)


def insert_ignore_tables(entries: list[TableEntry] = INDEXER) -> list[str]:
    return stream_scope("index", entries) + list(INSERT_IGNORE_EXTRA)


def parity_plan(db_type: str = "indexer", entries: list[TableEntry] = INDEXER) -> dict[str, str]:
    """Table -> bound (`block`, `tx`, `action`, `emission`, `id`) of the content-parity digest."""
    by_name = {e.table: e for e in entries}
    mutable = set(tables_with_hash_class("state_hash", entries))
    carved = PARITY_CARVE_OUTS[db_type]
    scopes = DECODER_TOPOLOGY if db_type == "decoder" else {
        s: stream_scope(s, entries) for s in ("block", "action", "index", "special")}
    plan: dict[str, str] = {}
    for scope, tables in scopes.items():
        for t in tables:
            if t in mutable or t in carved or t in plan:
                continue
            if scope == "index":
                by_height = db_type == "indexer" and by_name[t].rollback == "index"
                plan[t] = "block" if by_height else "id"
            elif t == "contract_emissions":
                plan[t] = "emission"
            else:
                plan[t] = "block" if scope == "special" else scope
    return plan


def write_mode(table: str, entries: list[TableEntry] = INDEXER) -> str:
    """How an incoming row of a table lands: `ignore`, `upsert`, `replace` or `insert`."""
    if table in insert_ignore_tables(entries):
        return "ignore"
    if table in UPSERT_TABLES:
        return "upsert"
    return "replace" if table in NATURAL_KEYS else "insert"


def snapshot_order(tables: DataFrame, entries: list[TableEntry] = INDEXER) -> DataFrame:
    """Eligible tables (column `table`) with their export position: lookups first, derived last."""
    hidden = tables_where(
        lambda e: e.replication in ("local", "hub-mirror", "follower-derived"), entries)
    name = F.col("table")
    rank = F.lit(len(PRIORITY_TABLES))
    for i, t in reversed(list(enumerate(PRIORITY_TABLES))):
        rank = F.when(name == t, i).otherwise(rank)
    for i, t in enumerate(TRAILING_TABLES):
        rank = F.when(name == t, len(PRIORITY_TABLES) + 1 + i).otherwise(rank)
    eligible = tables.where(~name.isin(*hidden, *NEVER_EXPORTED))
    return eligible.withColumn("export_rank", rank)


def topology_report(registry: DataFrame) -> DataFrame:
    """Table count and sorted names per replication scope and rollback mode."""
    return registry.groupBy("replication", "rollback").agg(
        F.count("*").alias("n_tables"),
        F.array_join(F.sort_array(F.collect_list("table")), ",").alias("tables"))
