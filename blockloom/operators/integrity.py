"""Block hashes, state hash, checksums and parity between two copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom import registry as reg
from blockloom.fixed_values import BLOCK_HASH_VERSION, GAS_TICK, STATE_HASH_VERSION
from blockloom.functions import canon, gates
from blockloom.operators import scan
from blockloom.operators.aggregates import latest_in_block
from blockloom.operators.ordered_hash import Layout, Segment, fragments, hash_documents, tails
from blockloom.session import part_count


def _arrays(*names: str) -> tuple[Segment, ...]:
    return tuple(Segment(i, ("{" if i == 0 else ",") + f'"{n}":[', "]") for i, n in enumerate(names))


# --- Fixed values: array order of the three block documents --------------------------------------
LEDGER_PARTS = ("credits", "debits", "escrows")
CONTRACT_PARTS = ("contracts", "state", "executions", "emissions", "deposits", "withdrawals")
BLOCK_LAYOUTS = [
    Layout("ledger", _arrays(*LEDGER_PARTS)),
    Layout("actions", (), numbered=True),
    Layout("contracts", _arrays(*CONTRACT_PARTS)),
]


def named_rows(tables: dict[str, DataFrame], name: str, ids: dict[str, tuple[str, str, str]]) -> DataFrame:
    """A table's rows with their block and with interned ids resolved (`out: (id, lookup, text)`)."""
    df = tables[name]
    if "block_index" not in df.columns:
        df = df.join(tables["actions"].select("action_index", "block_index"), "action_index")
    for out, (id_col, lookup, text) in ids.items():
        if out not in df.columns:
            df = scan.resolve(df, tables[lookup], id_col, text, out)
    return df


ADDRESS = ("index_addresses", "address")
TICK = ("tick_id", "index_tickers", "tick")
STATUS = ("status_id", "index_statuses", "status")


def key_collation(coin: str | None, network: str) -> Column:
    """Whether state keys of a row's height compare byte by byte; below its activation they fold letter case."""
    return gates.is_active("state_key_binary", F.col("block_index"), coin, network)


SORT_KEY = "__sort_key"  # a text key as it sorts, where that isn't as it is shown


def sort_columns(df: DataFrame, kind: str, i: int) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(numeric, text) sort keys of an array's rows."""
    numbers, texts = SORTED_BY[kind][i]
    return numbers, (SORT_KEY,) if SORT_KEY in df.columns else texts


def block_rows(tables: dict[str, DataFrame], state_key_binary: bool | Column = True) -> dict[tuple[str, int], DataFrame]:
    """The canonical per-block rows, one frame per document array present in `tables`.

    `state_key_binary`, for all heights or as a column over block_index, tells whether state keys that differ in case
    only are two keys; where they are one, keys also sort by their folded form.
    """
    out: dict[tuple[str, int], DataFrame] = {}
    for i, name in enumerate(LEDGER_PARTS):
        if name in tables:
            out["ledger", i] = named_rows(tables, name, {"address": ("address_id", *ADDRESS), "tick": TICK})
    if "actions" in tables:
        actions = tables["actions"]
        if "action" not in actions.columns:
            actions = scan.resolve(actions, tables["index_actions"], "action_id", "action", "action")
        out["actions", 0] = actions
    if "contracts" in tables:
        out["contracts", 0] = named_rows(tables, "contracts", {"source_address": ("source_id", *ADDRESS), "status": STATUS})
    if "contract_state" in tables:
        binary = F.lit(state_key_binary) if isinstance(state_key_binary, bool) else state_key_binary
        state = latest_in_block(tables["contract_state"], ["contract_index"], "state_key", "state_value", binary)
        out["contracts", 1] = state.withColumn(SORT_KEY, F.when(binary, F.col("state_key")).otherwise(F.upper("state_key")))
    if "contract_executions" in tables:
        out["contracts", 2] = named_rows(tables, "contract_executions", {"caller_address": ("caller_id", *ADDRESS), "status": STATUS})
    if "contract_emissions" in tables:
        runs = named_rows(tables, "contract_executions", {}).select(F.col("action_index").alias("execution_index"), "block_index")
        out["contracts", 3] = tables["contract_emissions"].drop("block_index").join(runs, "execution_index")
    for i, name in ((4, "deposits"), (5, "withdrawals")):
        if name in tables:
            out["contracts", i] = named_rows(tables, name, {"source_address": ("source_id", *ADDRESS), "tick": TICK, "status": STATUS})
    return out


# --- Fixed values: columns and sort keys of each array -------------------------------------------
SHOWN = {
    "ledger": [("action_index", "address", "tick", "amount")] * 3,
    "actions": [("action_index", "tx_index", "action")],
    "contracts": [
        ("action_index", "source_address", "code_hash", "status"),
        ("contract_index", "state_key", "state_value"),
        ("action_index", "contract_index", "caller_address", "gas_used", "status", "emitted_count"),
        ("execution_index", "emitted_action", "action_index", "position"),
        ("action_index", "contract_index", "source_address", "tick", "amount", "status"),
        ("action_index", "contract_index", "source_address", "tick", "amount", "status"),
    ],
}
SORTED_BY = {
    "ledger": [(("action_index",), ("address", "tick", "amount"))] * 3,
    "actions": [(("action_index",), ())],
    "contracts": [
        (("action_index",), ()),
        (("contract_index",), ("state_key",)),
        (("action_index",), ()),
        (("execution_index", "position"), ()),
        (("action_index", "contract_index"), ("source_address", "tick", "amount", "status")),
        (("action_index", "contract_index"), ("source_address", "tick", "amount", "status")),
    ],
}


def _block_fragments(tables: dict[str, DataFrame], state_key_binary: bool | Column) -> list[DataFrame]:
    parts = []
    for (kind, i), df in block_rows(tables, state_key_binary).items():
        numbers, texts = sort_columns(df, kind, i)
        shown = [canon_address(c) if kind == "ledger" and c == "address" else F.col(c) for c in SHOWN[kind][i]]
        types = dict(df.dtypes)
        late = kind == "ledger" and types["action_index"] in ("int", "bigint") and {types[c] for c in texts} == {"string"}
        parts.append(fragments(df, kind, i, shown, numbers, texts, late))
    return parts


def late_ledger_row() -> Column:
    """Text of a ledger row from its sort keys, which are all that it shows."""
    shown = F.struct(F.col("n1").alias("action_index"), scan.canonical_role(F.col("s1")).alias("address"), F.col("s2").alias("tick"), F.col("s3").alias("amount"))
    return F.when(F.col("kind") == "ledger", F.to_json(shown, {"ignoreNullFields": "false"}))


def canon_address(column: str) -> Column:
    """Addresses are replaced by their role only after the sort on the stored text."""
    return scan.canonical_role(F.col(column)).alias(column)


def _block_tail(previous: Column) -> Column:
    return F.concat(F.lit('"block_index":'), F.col("block_index").cast("string"), previous,
                    F.lit(f',"hash_version":{BLOCK_HASH_VERSION}}}'))


def block_hashes(tables: dict[str, DataFrame], blocks: DataFrame, state_key_binary: bool | Column = True) -> DataFrame:
    """(block_index, ledger_hash, actions_hash, contract_hash) recomputed from rows.

    `blocks` holds every block to hash with its committed hashes; the previous hash comes from
    the committed predecessor, so all blocks are checked independently.  No predecessor row: the
    key is absent.  A predecessor whose hash is unknown: the key is null.
    """
    committed = {"ledger": "ledger_hash", "actions": "actions_hash", "contracts": "contract_hash"}
    prior = blocks.select((F.col("block_index") + 1).alias("block_index"), F.lit(True).alias("__seen"),
                          *[F.col(c).alias(f"__{k}") for k, c in committed.items()])
    heads = blocks.select("block_index").join(prior, "block_index", "left")
    parts = _block_fragments(tables, state_key_binary)
    for kind in committed:
        known = F.concat(F.lit(',"previous_hash":"'), F.col(f"__{kind}"), F.lit('"'))
        previous = F.when(F.col("__seen"), F.coalesce(known, F.lit(',"previous_hash":null'))).otherwise("")
        lead = F.lit("" if kind == "actions" else ",")
        parts.append(tails(heads, kind, F.concat(lead, _block_tail(previous))))
    wanted = blocks.select("block_index")
    rows = reduce(DataFrame.unionByName, parts).join(wanted, "block_index", "left_semi")
    return _by_block(hash_documents(rows, BLOCK_LAYOUTS, late=late_ledger_row()))


def _by_block(hashes: DataFrame) -> DataFrame:
    pick = lambda k, n: F.max(F.when(F.col("kind") == k, F.col("hash"))).alias(n)
    return hashes.groupBy("block_index").agg(pick("ledger", "ledger_hash"), pick("actions", "actions_hash"),
                                             pick("contracts", "contract_hash"))


def commit_block_hashes(tables: dict[str, DataFrame], new_blocks: DataFrame, seeds: dict[str, str],
                        state_key_binary: bool | Column = True) -> DataFrame:
    """Hashes for a window of consecutive new blocks, each chained to the one before; `seeds` holds
    the last committed ledger, actions and contracts hash."""
    parts = _block_fragments(tables, state_key_binary)
    for kind in ("ledger", "actions", "contracts"):
        lead = F.lit("" if kind == "actions" else ",")
        parts.append(tails(new_blocks, kind, F.concat(lead, _block_tail(F.lit(',"previous_hash":"%PREVIOUS%"')))))
    rows = reduce(DataFrame.unionByName, parts).join(new_blocks.select("block_index"), "block_index", "left_semi")
    return _by_block(hash_documents(rows, BLOCK_LAYOUTS, seeds, late_ledger_row()))


# ---- state hash --------------------------------------------------------------------------------
# --- Fixed values: nested arrays of the state document, in order, with their feature gates --------
STATE_PARTS = (
    ("deactivations", ("stakes", "delegations", "contract_stakes", "contract_delegations"), None),
    ("slashes", ("stakes", "unstakes", "contract_stakes", "contract_unstakes"), None),
    ("request_status", ("attests", "xcalls"), None),
    ("cooldown", ("unstakes", "contract_unstakes"), None),
    ("credits", None, None),
    ("anchor_invalid", None, None),
    ("index_addresses_new", None, "index_map_hash"),
    ("index_tickers_new", None, "index_map_hash"),
    ("poll_finalize", None, "poll_finalize_hash"),
    ("token_supply", None, "token_supply_hash"),
    ("bet_feed_status", None, "bet_status_hash"),
    ("bet_status", None, "bet_status_hash"),
)
POLL_COLUMNS = ("action_index", "poll_status", "winning_option", "total_weight", "total_voters", "quorum_met", "min_voters_met",
                "fail_reason", "decided_early", "effective_close_block", "finalized_action_index", "resolved_block",
                "deposit_resolved", "callback_execute_action_index")


def state_layout(coin: str | None, network: str, omit: tuple[str, ...] = ()) -> tuple[Layout, dict[tuple[str, str | None], int]]:
    segments, index = [], {}
    for name, inner, gate in STATE_PARTS:
        if name in omit:
            continue
        height = 0 if gate is None else gates.activation_height(gate, coin, network)
        for j, table in enumerate(inner or (None,)):
            part = len(segments)
            index[name, table] = part
            lead = "{" if part == 0 else ","
            before = f'{lead}"{name}":' + ('{' if table and j == 0 else "")
            before = f'{before}"{table}":[' if table and j == 0 else f',"{table}":[' if table else f"{before}["
            after = "]}" if table and j == len(inner) - 1 else "]"
            segments.append(Segment(part, before, after, height))
    return Layout("state", tuple(segments)), index


def state_rows(tables: dict[str, DataFrame], delay: int | None, gas_tick: str, coin: str | None,
               network: str) -> dict[tuple[str, str | None], tuple[DataFrame, list, list, list]]:
    """Mutation classes as (rows with block_index, shown, numeric keys, text keys); absent tables or
    columns leave the class empty."""
    out: dict = {}
    have = lambda t, *cols: t in tables and set(cols) <= set(tables[t].columns)
    at = lambda df, col: df.where(F.col(col).isNotNull()).withColumn("block_index", F.col(col))
    statuses = tables.get("index_statuses")

    def with_status(df: DataFrame, id_col: str = "status_id", out_col: str = "status", how: str = "left") -> DataFrame:
        names = statuses.select(F.col("id").alias(id_col), F.col("status").alias(out_col))
        return df.join(names, id_col, how)

    for t in ("stakes", "delegations", "contract_stakes", "contract_delegations"):
        if have(t, "deactivation_block") and delay is not None:
            rows = at(tables[t], "deactivation_block").withColumn("block_index", F.col("deactivation_block") - delay)
            out["deactivations", t] = (rows, ["action_index", "deactivation_block"], ["action_index"], [])
    for t, log in (("stakes", "capability_slash_debits"), ("unstakes", "capability_slash_debits"),
                   ("contract_stakes", "contract_slash_debits"), ("contract_unstakes", "contract_slash_debits")):
        if have(t, "amount") and log in tables:
            cuts = tables[log].where(F.col("target_table") == t).select(
                F.col("stake_action_index").alias("action_index"), "block_index").distinct()
            rows = tables[t].select("action_index", "amount").join(cuts, "action_index").distinct()
            out["slashes", t] = (rows, ["action_index", "amount"], ["action_index"], [])
    for t in ("attests", "xcalls"):
        if have(t, "resolved_block", "version"):
            rows = at(tables[t].where("version = 0"), "resolved_block")
            out["request_status", t] = (rows, ["action_index", "request_status", "resolved_block"], ["action_index"], [])
    if statuses is not None:
        for t in ("unstakes", "contract_unstakes"):
            if have(t, "cooldown_end_block"):
                out["cooldown", t] = (with_status(at(tables[t], "cooldown_end_block")), ["action_index", "status"], ["action_index"], [])
        if have("credits") and have("unstakes") and have("contract_unstakes"):
            done = statuses.where("status = 'completed'").select(F.col("id").alias("status_id"))
            named = scan.resolve(scan.resolve(tables["credits"], tables["index_addresses"], "address_id", "address", "address"),
                                 tables["index_tickers"], "tick_id", "tick", "tick")
            keyed = lambda t, *c: at(tables[t], "cooldown_end_block").join(done, "status_id", "left_semi").select(
                "action_index", F.col("source_id").alias("address_id"), *c, "block_index")
            cols = ["action_index", "address", "tick", "amount", "block_index"]
            by_gas = named.where(F.col("tick") == gas_tick).join(keyed("unstakes"), ["action_index", "address_id"]).select(*cols)
            by_tick = named.join(keyed("contract_unstakes", "tick_id"), ["action_index", "address_id", "tick_id"]).select(*cols)
            out["credits", None] = (by_gas.unionByName(by_tick), cols[:4], ["action_index"], ["address", "tick", "amount"])
        if have("anchor_actions", "match_batch_seq"):
            named = with_status(tables["anchor_actions"])
            height = F.col("block_index_doge") if have("anchor_actions", "block_index_doge") else F.lit(None).cast("bigint")
            chunks = named.where("version = 2 and status = 'valid'")
            by_key = lambda col, on: chunks.select("match_batch_seq", col.alias("__b")).where(
                gates.is_active("archive_height_key", F.col("__b"), coin, network) == on)
            stamped = by_key(height, True).unionByName(by_key(F.col("block_index"), False)).where("__b is not null")
            heads = named.where("status = 'invalid_archive'").select("match_batch_seq", "action_index", "status", "version")
            wide = gates.is_active("archive_invalid_hash", F.col("__b"), coin, network)
            rows = heads.join(stamped, "match_batch_seq").where((F.col("version") == 1) | (wide & (F.col("version") == 6)))
            out["anchor_invalid", None] = (rows.withColumn("block_index", F.col("__b")), ["action_index", "status"], ["action_index"], [])
    for name, t, text in (("index_addresses_new", "index_addresses", "address"), ("index_tickers_new", "index_tickers", "tick")):
        if have(t, "block_index"):
            out[name, None] = (tables[t].where("block_index is not null"), ["id", text], ["id"], [])
    if have("polls", *POLL_COLUMNS):
        out["poll_finalize", None] = (at(tables["polls"], "resolved_block"), list(POLL_COLUMNS), ["action_index"], [])
    if have("tokens", "supply") and have("actions") and all(have(t) for t in LEDGER_PARTS):
        heights = tables["actions"].select("action_index", "block_index")
        ticks = reduce(DataFrame.union, [
            tables[t].where("tick_id is not null").join(heights, "action_index").select("block_index", "tick_id").distinct()
            for t in LEDGER_PARTS]).distinct()
        named = tables["tokens"].join(tables["index_tickers"].select(F.col("id").alias("tick_id"), "tick"), "tick_id")
        out["token_supply", None] = (ticks.join(named.select("tick_id", "tick", "supply"), "tick_id"), ["tick", "supply"], [], ["tick"])
    if statuses is not None and have("bet_feeds", "closed_block", "terminal_block"):
        named = with_status(tables["bet_feeds"], "feed_status_id", "feed_status", "inner")
        stamps = F.explode(F.array_distinct(F.array_compact(F.array("closed_block", "terminal_block"))))
        out["bet_feed_status", None] = (named.withColumn("block_index", stamps),
                                        ["action_index", "feed_status", "closed_block", "terminal_block"], ["action_index"], [])
    if statuses is not None and have("bets", "settled_block"):
        named = with_status(at(tables["bets"], "settled_block"), "bet_status_id", "bet_status", "inner")
        out["bet_status", None] = (named, ["action_index", "bet_status", "settled_block"], ["action_index"], [])
    return out


def state_hashes(tables: dict[str, DataFrame], blocks: DataFrame, delay: int | None, coin: str | None, network: str,
                 gas_tick: str = GAS_TICK, omit: tuple[str, ...] = ()) -> DataFrame:
    """(block_index, state_hash) of the mutation classes of each block.  Meaningful for a height only
    while the tables are as they were right after it."""
    layout, index = state_layout(coin, network, omit)
    parts = [fragments(df, "state", index[key], shown, numbers, texts)
             for key, (df, shown, numbers, texts) in state_rows(tables, delay, gas_tick, coin, network).items() if key in index]
    wanted = blocks.select("block_index")
    tail = F.concat(F.lit(',"block_index":'), F.col("block_index").cast("string"), F.lit(f',"state_hash_version":{STATE_HASH_VERSION}}}'))
    rows = reduce(DataFrame.unionByName, [*parts, tails(wanted, "state", tail)]).join(wanted, "block_index", "left_semi")
    return hash_documents(rows, [layout]).select("block_index", F.col("hash").alias("state_hash"))


# ---- checksums ---------------------------------------------------------------------------------
def index_map_checksum(addresses: DataFrame, upto: int) -> DataFrame:
    """Hash of the ordered id -> address map assigned up to a height; ids outside any block stay out."""
    rows = addresses.where(F.col("block_index").isNotNull() & (F.col("block_index") <= upto)).select(
        F.lit(upto).cast("bigint").alias("block_index"), "id", "address")
    shown = [F.col("id").cast("string").alias("id"), F.col("address").cast("string").alias("address")]
    layout = Layout("index_map", (Segment(0, '{"index_map":[', "]"),))
    head = addresses.sparkSession.range(1).select(F.lit(upto).cast("bigint").alias("block_index"))
    parts = fragments(rows, "index_map", 0, shown, ["id"]).unionByName(tails(head, "index_map", F.lit("}")))
    return hash_documents(parts, [layout]).select("block_index", F.col("hash").alias("checksum"))


def exact_content_digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, digest) as the protocol publishes it: hash of {"table", "rows"} with the row texts sorted."""
    parts, layouts = [], []
    for name, df in tables.items():
        text = canon.sorted_row_json(df.schema, set(reg.DIGEST_DROPPED_COLUMNS.get(name, ())))
        rows = df.select(F.lit(0).alias("block_index"), text.alias("r"))
        parts.append(_raw_fragments(rows, name))
        parts.append(tails(df.sparkSession.range(1).select(F.lit(0).alias("block_index")), name, F.lit("}")))
        layouts.append(Layout(name, (Segment(0, f'{{"table":"{name}","rows":[', "]"),)))
    return hash_documents(reduce(DataFrame.unionByName, parts), layouts).select(F.col("kind").alias("table"), F.col("hash").alias("digest"))


def _raw_fragments(df: DataFrame, kind: str) -> DataFrame:
    """Fragments whose text is ready: sorted by the plain row text, shown as the quoted one."""
    return fragments(df, kind, 0, ["r"], [], ["r"]).select(
        *[c for c in ("block_index", "kind", "part", "n1", "n2", "s1", "s2", "s3", "s4")],
        F.to_json(F.array("s1")).alias("q")).withColumn("row", F.expr("substring(q, 2, length(q) - 2)")).drop("q")


DIGEST_DIGITS = 6  # leading hex digits of the finest bucket: 16.7 million buckets per table


def content_digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows, digest): an order-independent tree digest that never gathers a table.

    Row hashes are counted first, so copies of one row are one entry; distinct hashes fall evenly
    into buckets by their own leading digits, bucket digests fold into groups and those into one.
    """
    parts = []
    for name, df in tables.items():
        row = canon.sha256(canon.sorted_row_json(df.schema, set(reg.DIGEST_DROPPED_COLUMNS.get(name, ()))))
        parts.append(df.select(F.lit(name).alias("table"), F.unhex(row).alias("h"), F.spark_partition_id().alias("at")))
    rows = reduce(DataFrame.unionByName, parts)
    tasks = part_count(rows)  # grows with the input, so what a task counts and folds doesn't
    # copies of one row lie by the task they come from, so a row with many is spread; then each task's counts are one entry
    counted = rows.repartition(tasks, "table", "h", "at").groupBy("table", "h", "at").agg(F.count("*").alias("n"))
    # hashes travel as bytes and lie by the bucket above the finest, so both levels fold where they lie
    near = counted.withColumn("up", F.lower(F.hex(F.substring("h", 1, DIGEST_DIGITS // 2 - 1)))).repartition(tasks, "table", "up").groupBy(
        "table", "up", "h").agg(F.sum("n").alias("n"))
    text = F.lower(F.hex("h"))
    level = near.select("table", "up", text.substr(1, DIGEST_DIGITS).alias("b"), F.concat_ws(":", text, F.col("n").cast("string")).alias("d"), "n")
    for digits in range(DIGEST_DIGITS - 2, -1, -2):
        folded = level.groupBy("table", *(["up", "b"] if digits == DIGEST_DIGITS - 2 else ["b"])).agg(
            canon.sha256(F.array_join(F.array_sort(F.collect_list("d")), ",")).alias("d"), F.sum("n").alias("n"))
        up = F.col("up") if digits == DIGEST_DIGITS - 2 else F.substring("b", 1, digits)
        level = folded.select("table", up.alias("b"), F.concat_ws(":", "b", "d").alias("d"), "n")
    return level.groupBy("table").agg(
        F.sum("n").alias("n_rows"), canon.sha256(F.array_join(F.array_sort(F.collect_list("d")), ",")).alias("digest"))


def parity_windows(tables: dict[str, DataFrame], plan: dict[str, str], upto: int, window: int,
                   id_bounds: dict[str, int]) -> dict[str, DataFrame]:
    """Each table cut to its parity window: `window` heights, or `window` ids below the bound the
    source published."""
    low, out = max(0, upto - window + 1), {}
    for name, bound in plan.items():
        df = tables.get(name)
        if df is None:
            continue
        if bound == "block":
            out[name] = df.where(scan.in_window("block_index", low, upto))
        elif bound == "action":
            out[name] = scan.block_scan(df, low, upto) if name == "actions" else scan.action_scan(df, tables["actions"], low, upto)
        elif bound == "tx":
            out[name] = scan.tx_scan(df, tables["transactions"], low, upto)
        elif bound == "emission":
            runs = scan.action_scan(tables["contract_executions"], tables["actions"], low, upto)
            out[name] = df.join(runs.select(F.col("action_index").alias("execution_index")), "execution_index", "left_semi")
        elif name in id_bounds:
            top = id_bounds[name]
            out[name] = df.where((F.col("id") > max(0, top - window)) & (F.col("id") <= top))
    return out


# ---- comparison --------------------------------------------------------------------------------
def compare_block_hashes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per differing hash field of a height both copies have."""
    fields = ("ledger_hash", "actions_hash", "contract_hash")
    right = b.select("block_index", *[F.col(f).alias(f"__{f}") for f in fields])
    rows = a.join(right, "block_index").select("block_index", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("a"), F.col(f"__{f}").alias("b")) for f in fields])).alias("x"))
    return rows.select("block_index", "x.field", "x.a", "x.b").where(~F.col("a").eqNullSafe(F.col("b")))


def compare_content(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Verdict per table; digests only count where the row counts agree."""
    r = remote.select("table", F.col("n_rows").alias("remote_rows"), F.col("digest").alias("__d"))
    joined = local.withColumnRenamed("n_rows", "local_rows").join(r, "table", "full_outer")
    verdict = (F.when(F.col("local_rows").isNull(), "skipped: absent locally")
               .when(F.col("remote_rows").isNull(), "skipped: absent on source")
               .when(F.col("local_rows") != F.col("remote_rows"), "skipped: row count differs")
               .when(F.col("digest") != F.col("__d"), "mismatch").otherwise("match"))
    return joined.select("table", "local_rows", "remote_rows", verdict.alias("verdict"))


def compare_counts(remote: DataFrame, local: DataFrame, same_height: bool, exact: list[str]) -> DataFrame:
    """Tables the replica is short of, and those it is ahead of where exact parity is due at one height."""
    r = remote.select("table", F.col("n_rows").alias("source_count"))
    joined = r.join(local.select("table", F.col("n_rows").alias("local_count")), "table", "left").withColumn(
        "local_count", F.coalesce("local_count", F.lit(0).cast("bigint")))
    ahead = (F.col("local_count") > F.col("source_count")) & F.lit(same_height) & F.col("table").isin(*exact)
    reason = F.when(F.col("source_count") > F.col("local_count"), "replica-short").when(ahead, "replica-ahead")
    return joined.withColumns({"delta": F.col("source_count") - F.col("local_count"), "reason": reason}).where("reason is not null")


def broken_continuity(blocks: DataFrame) -> DataFrame:
    """Heights above the lowest whose predecessor is absent."""
    after = blocks.select((F.col("block_index") + 1).alias("block_index"))
    lowest = blocks.agg(F.min("block_index")).scalar()
    return blocks.select("block_index").distinct().join(after, "block_index", "left_anti").where(F.col("block_index") > lowest)


def compare_roots(computed: DataFrame, committed: DataFrame, fields: list[str]) -> DataFrame:
    """One row per root that differs from the committed one, letter case ignored; unknown commits pass."""
    right = committed.select("block_index", *[F.col(f).alias(f"__{f}") for f in fields])
    rows = computed.join(right, "block_index").select("block_index", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("computed"), F.col(f"__{f}").alias("committed")) for f in fields])).alias("x"))
    return rows.select("block_index", "x.field", "x.computed", "x.committed").where(
        F.col("committed").isNotNull() & ~F.lower("computed").eqNullSafe(F.lower("committed")))
