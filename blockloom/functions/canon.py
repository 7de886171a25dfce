"""Canonical text, JSON and domain-separated hashing as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockloom.fixed_values import (
    BALANCE_DOMAIN,
    CONTRACT_STATE_DOMAIN,
    EMPTY_LEAF_TAG,
    ESCROW_DOMAIN,
    SMT_DEPTH,
    STAKE_DOMAIN,
    STATE_SUBTREES,
)
from blockloom.functions.decimals import canonical_amount

LEAF_MARK, NODE_MARK, EMPTY_MARK = b"\x00", b"\x01", b"\x02"
NUL = "\x00"


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def pair_digest(left: bytes, right: bytes) -> bytes:
    return digest(NODE_MARK + left + right)


def _empty_roots() -> list[bytes]:
    roots = [digest(EMPTY_MARK + EMPTY_LEAF_TAG.encode())]
    while len(roots) <= SMT_DEPTH:
        roots.append(pair_digest(roots[-1], roots[-1]))
    return roots


EMPTY_ROOTS = _empty_roots()  # EMPTY_ROOTS[h] is the root of an all-empty subtree of height h
EMPTY_SMT_ROOT = EMPTY_ROOTS[SMT_DEPTH].hex()


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def no_nul(field: Column) -> Column:
    text = field.cast("string")
    return F.when(F.instr(text, NUL) > 0, F.raise_error(F.lit("field contains NUL"))).otherwise(text)


def join_fields(*fields: Column | str) -> Column:
    """NUL-joined fields, NULL as the empty string.  A field holding NUL raises."""
    parts = [F.lit(f) if isinstance(f, str) else F.coalesce(no_nul(f), F.lit("")) for f in fields]
    return F.concat_ws(NUL, *parts)


def leaf_hash(content: Column) -> Column:
    return F.sha2(F.concat(F.lit(LEAF_MARK), content.cast("binary")), 256)


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.lit(NODE_MARK), F.unhex(left), F.unhex(right)), 256)


def smt_key(domain: str, *fields: Column) -> Column:
    return sha256(join_fields(domain, *fields))


def balance_key(chain: Column, network: Column, address: Column, tick: Column) -> Column:
    return smt_key(BALANCE_DOMAIN, chain, network, address, tick)


def escrow_key(chain: Column, network: Column, address: Column, tick: Column) -> Column:
    return smt_key(ESCROW_DOMAIN, chain, network, address, tick)


def stake_key(pubkey: Column, capability: Column) -> Column:
    return smt_key(STAKE_DOMAIN, pubkey, capability)


def contract_state_key(chain: Column, network: Column, contract: Column, key: Column) -> Column:
    return smt_key(CONTRACT_STATE_DOMAIN, chain, network, contract.cast("string"), key)


def amount_leaf(amount: Column) -> Column:
    return leaf_hash(canonical_amount(amount))


def stake_member_leaf(source: Column, weight: Column) -> Column:
    return leaf_hash(join_fields("STK", source, canonical_amount(weight)))


def stake_total_leaf(total: Column) -> Column:
    return leaf_hash(join_fields("STKTOTAL", canonical_amount(total)))


def ledger_leaf(kind: Column, action_index: Column, address: Column, tick: Column, amount: Column) -> Column:
    return leaf_hash(join_fields("L", kind, action_index, address, tick, amount))


def action_leaf(action_index: Column, tx_index: Column, action: Column) -> Column:
    return leaf_hash(join_fields("A", action_index, tx_index, action))


def contract_leaf(sub_table: str, *fields: Column) -> Column:
    return leaf_hash(join_fields("C", sub_table, *fields))


def state_root(**sub_roots: Column) -> Column:
    """Root over the five named slots, padded to eight; an absent slot is the empty-tree root."""
    absent = F.lit(EMPTY_SMT_ROOT)
    layer = [F.coalesce(sub_roots[n], absent) if n in sub_roots else absent for n in STATE_SUBTREES]
    layer += [F.lit(EMPTY_ROOTS[0].hex())] * (8 - len(layer))
    while len(layer) > 1:
        layer = [node_hash(layer[i], layer[i + 1]) for i in range(0, len(layer), 2)]
    return layer[0]


def state_root_proof(slot: str, **sub_roots: Column) -> Column:
    """Bottom-up sibling array that ties one named slot to the state root."""
    absent = F.lit(EMPTY_SMT_ROOT)
    layer = [F.coalesce(sub_roots[n], absent) if n in sub_roots else absent for n in STATE_SUBTREES]
    layer += [F.lit(EMPTY_ROOTS[0].hex())] * (8 - len(layer))
    at, siblings = STATE_SUBTREES.index(slot), []
    while len(layer) > 1:
        siblings.append(layer[at ^ 1])
        layer = [node_hash(layer[i], layer[i + 1]) for i in range(0, len(layer), 2)]
        at >>= 1
    return F.array(*siblings)


def fold_proof(leaf: Column, index: Column, siblings: Column) -> Column:
    """Root implied by a fixed-tree inclusion proof (leaf hash, leaf position, bottom-up siblings)."""
    start = F.struct(leaf.alias("h"), index.cast("bigint").alias("i"))

    def step(acc: Column, sibling: Column) -> Column:
        even = acc["i"] % 2 == 0
        joined = F.when(even, node_hash(acc["h"], sibling)).otherwise(node_hash(sibling, acc["h"]))
        return F.struct(joined.alias("h"), F.shiftright(acc["i"], 1).alias("i"))

    return F.aggregate(siblings, start, step, lambda acc: acc["h"])


def log_leaf(ledger: Column, actions: Column, contract: Column) -> Column:
    """Epoch-log leaf: hash of the three hex texts, missing as empty."""
    return sha256(F.concat(*[F.coalesce(c, F.lit("")) for c in (ledger, actions, contract)]))


def log_pair(left: Column, right: Column) -> Column:
    return sha256(F.concat(left, right))


def hash_tuple(ledger: Column, actions: Column, contract: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in (ledger, actions, contract)])


def json_row(*cols: Column) -> Column:
    """JSON object in the given column order, NULL kept."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def sorted_row_json(df_schema, excluded: set[str] = frozenset()) -> Column:
    """One row as JSON with sorted keys and text values: bytes as hex, instants as ISO-8601 UTC."""
    fields = sorted((f for f in df_schema.fields if f.name not in excluded), key=lambda f: f.name)
    shown = []
    for f in fields:
        kind, col = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind == "binary":
            col = F.lower(F.hex(col))
        elif kind in ("timestamp", "timestamp_ntz"):
            col = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        shown.append(col.cast("string").alias(f.name))
    return json_row(*shown)


def encode_binary_json(df, also: list[str] = ()):
    """Row JSON for exchange: binary columns become {"__xbin__": base64}; `also` are columns kept beside it."""
    shown = []
    for f in (f for f in df.schema.fields if f.name not in also):
        col = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "binary":
            col = F.when(col.isNotNull(), F.struct(F.base64(col).alias("__xbin__")))
        shown.append(col.alias(f.name))
    return df.select(json_row(*shown).alias("row_json"), *also)


def decode_binary_json(df, schema, column: str = "row_json", also: list = ()):
    """Inverse of `encode_binary_json` for a known schema; `also` are columns of `df` to keep."""
    from pyspark.sql import types as T

    wire = T.StructType([
        T.StructField(f.name, T.StructType([T.StructField("__xbin__", T.StringType())])
                      if f.dataType.typeName() == "binary" else f.dataType)
        for f in schema.fields
    ])
    parsed = df.select(F.from_json(column, wire).alias("r"), *also)
    return parsed.select(*[
        (F.unbase64(F.col(f"r.`{f.name}`.__xbin__")) if f.dataType.typeName() == "binary"
         else F.col(f"r.`{f.name}`")).alias(f.name)
        for f in schema.fields
    ], *parsed.columns[1:])


def checkpoint_text(with_commitment: Column, with_header: Column) -> Column:
    """Canonical checkpoint text over columns named after the checkpoint fields."""
    from blockloom.fixed_values import CHECKPOINT_TAG, EQUIVOCATION_PREFIX

    shown = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    base = F.concat_ws("|", F.lit(CHECKPOINT_TAG), *[shown(n) for n in (
        "chain", "network", "block_index", "block_hash", "ledger_hash", "actions_hash",
        "contract_hash", "checkpoint_seq", "snapshot_block")])
    roots = ("state_root", "state_root_version", "block_merkle_root", "block_merkle_version")
    present = with_commitment
    for n in roots:
        present = present & F.col(n).isNotNull()
    suffix = F.concat_ws("|", F.lower("state_root"), shown("state_root_version"),
                         F.lower("block_merkle_root"), shown("block_merkle_version"))
    raw = F.when(present, F.concat_ws("|", base, suffix)).otherwise(base)
    round_id = F.concat_ws("|", *[shown(n) for n in ("chain", "network", "block_index", "checkpoint_seq")])
    header = F.concat(F.lit(f"{EQUIVOCATION_PREFIX}|{CHECKPOINT_TAG}|"), round_id, F.lit("|0||"))
    return F.when(with_header, F.concat(header, raw)).otherwise(raw)


def strict_height(text: Column) -> Column:
    """Non-negative whole number or NULL."""
    shown = text.cast("string")
    return F.when(shown.rlike("^[0-9]+$"), shown.try_cast("bigint"))


def backoff_ms(base: int, ceiling: int, attempt: Column) -> Column:
    return F.least(F.lit(float(ceiling)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt)).cast("bigint")


def lag_blocks(source: Column, applied: Column, stale: Column | None = None) -> Column:
    """Blocks behind, never negative; NULL when a side is unknown or stale."""
    known = source.isNotNull() & applied.isNotNull()
    if stale is not None:
        known = known & ~F.coalesce(stale, F.lit(False))
    return F.when(known, F.greatest(F.lit(0).cast("bigint"), (source - applied).cast("bigint")))
