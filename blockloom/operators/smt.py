"""Sparse Merkle tree over a DataFrame of (key, leaf): roots, increments and proofs.

Keys are SHA-256 digests, so a bit prefix of the key splits the leaves evenly whatever the
ledger's own skew is.  One task folds one prefix; the 2^bits prefix roots are folded after.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from blockloom.fixed_values import SMT_DEPTH, STAKE_TOTAL_PUBKEY
from blockloom.functions import canon
from blockloom.functions import decimals as D
from blockloom.functions.decimals import canonical_amount
from blockloom.operators import aggregates as agg
from blockloom.operators import scan
from blockloom.session import materialise, part_count, task_count

PREFIX_DIGITS = 3  # hex digits of the key that pick a subtree: 4096 even parts; raise with the data
ZERO = "0." + "0" * D.SCALE


def balance_leaves(credits: DataFrame, debits: DataFrame, addresses: DataFrame, tickers: DataFrame,
                   chain: str, network: str) -> DataFrame:
    """Key and leaf of every non-zero net balance whose address and tick resolve."""
    net = agg.balances(credits, debits)
    named = scan.resolve(net, addresses, "address_id", "address", "address")
    named = scan.resolve(named, tickers, "tick_id", "tick", "tick").where(
        "address is not null and tick is not null")
    key = canon.balance_key(F.lit(chain), F.lit(network), F.col("address"), F.col("tick"))
    return named.select(key.alias("key"), canon.amount_leaf(F.col("amount")).alias("leaf"))


def prefix_digits(leaf_count: int, per_part: int = 50_000) -> int:
    """Hex digits that keep a subtree near `per_part` leaves; keys are digests, so parts are even."""
    digits = PREFIX_DIGITS
    while leaf_count > per_part * 16**digits and digits < 8:
        digits += 1
    return digits


# ---- leaves ------------------------------------------------------------------------------------
def escrow_leaves(journal: DataFrame, addresses: DataFrame, tickers: DataFrame, chain: str, network: str,
                  as_of: int | None = None) -> DataFrame:
    """Key and leaf of every locked amount: latest journal row per pair; released or zero is absent."""
    live = agg.latest_per_key(journal, agg.PAIR, "locked_amount", as_of=as_of).where("locked_amount <> ''")
    named = (live.join(addresses.select(F.col("id").alias("address_id"), "address"), "address_id")
             .join(tickers.select(F.col("id").alias("tick_id"), "tick"), "tick_id"))
    amount = canonical_amount(F.col("locked_amount"))
    key = canon.escrow_key(F.lit(chain), F.lit(network), F.col("address"), F.col("tick"))
    return named.where(amount != ZERO).select(key.alias("key"), canon.leaf_hash(amount).alias("leaf"))


def contract_state_leaves(journal: DataFrame, chain: str, network: str, as_of: int | None = None) -> DataFrame:
    """Key and leaf of every live contract value; the raw text is hashed and '' is a value."""
    live = agg.latest_per_key(journal, ["contract_index", "state_key"], "state_value", as_of=as_of)
    key = canon.contract_state_key(F.lit(chain), F.lit(network), F.col("contract_index"), F.col("state_key"))
    return live.select(key.alias("key"), canon.leaf_hash(F.col("state_value")).alias("leaf"))


def stake_leaves(weights: DataFrame) -> DataFrame:
    """Member leaf per (pubkey, capability) and one total leaf per capability, each source once.

    `weights`: capability, pubkey, source, weight (decimal text).  Zero weights cannot qualify.
    """
    counted = weights.where(canonical_amount(F.col("weight")) != ZERO)
    members = counted.select(canon.stake_key(F.col("pubkey"), F.col("capability")).alias("key"),
                             canon.stake_member_leaf(F.col("source"), F.col("weight")).alias("leaf"))
    per_source = counted.groupBy("capability", "source").agg(F.min("weight").alias("weight"))
    totals = D.exact_sum(per_source, ["capability"], "weight", "total").where("total_nonzero")
    return members.unionByName(totals.select(
        canon.stake_key(F.lit(STAKE_TOTAL_PUBKEY), F.col("capability")).alias("key"),
        canon.stake_total_leaf(F.col("total")).alias("leaf")))


# ---- tree --------------------------------------------------------------------------------------
_EMPTY_BELOW = [canon.EMPTY_ROOTS[SMT_DEPTH - d - 1::-1] if d < SMT_DEPTH else [] for d in range(SMT_DEPTH + 1)]  # siblings from depth d down, all empty


def _bit(key: bytes, depth: int) -> int:
    return key[depth >> 3] >> (7 - (depth & 7)) & 1


def lifted(key: bytes, node: bytes, depth: int) -> bytes:
    """A lone leaf carried up to `depth` against empty siblings."""
    sha, mark = hashlib.sha256, _MARK
    for bit, left, right in zip(f"{int.from_bytes(key, 'big'):0{SMT_DEPTH}b}"[:depth - 1 if depth else None:-1], _EMPTY_LEFT, canon.EMPTY_ROOTS):
        node = sha(left + node if bit == "1" else mark + node + right).digest()
    return node


_MARK = canon.NODE_MARK
_EMPTY_LEFT = [_MARK + e for e in canon.EMPTY_ROOTS]


class _Subtree:
    """Leaves of one prefix, sorted by key; `node` gives the root of any run of them at a depth."""

    def __init__(self, keys: list[str], leaves: list[str]):
        pairs = sorted(zip((bytes.fromhex(k) for k in keys), (bytes.fromhex(v) for v in leaves)))
        self.keys, self.leaves = [k for k, _ in pairs], [v for _, v in pairs]
        if any(a == b for a, b in zip(self.keys, self.keys[1:])):
            raise ValueError("duplicate tree key")
        self.seen: dict[tuple[int, int, int], bytes] = {}

    def split(self, low: int, high: int, depth: int) -> int:
        """First index in [low, high) whose bit at `depth` is set."""
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if _bit(self.keys[mid], depth) else (mid + 1, high)
        return low

    def lift(self, i: int, depth: int) -> bytes:
        """A lone leaf carried up to `depth` against empty siblings."""
        return lifted(self.keys[i], self.leaves[i], depth)

    def node(self, low: int, high: int, depth: int) -> bytes:
        if low == high:
            return canon.EMPTY_ROOTS[SMT_DEPTH - depth]
        found = self.seen.get((low, high, depth))
        if found is None:
            if high - low == 1:
                found = self.lift(low, depth)
            else:
                mid = self.split(low, high, depth)
                found = canon.pair_digest(self.node(low, mid, depth + 1), self.node(mid, high, depth + 1))
            self.seen[low, high, depth] = found
        return found

    def path(self, key: bytes, depth: int) -> tuple[list[bytes], bytes | None]:
        """Siblings from `depth` down to the leaf level, and the leaf when present."""
        low, high, siblings = 0, len(self.keys), []
        for d in range(depth, SMT_DEPTH):
            if low == high or high - low == 1 and self.keys[low] == key:
                siblings += _EMPTY_BELOW[d]  # nothing else lies below
                break
            mid = self.split(low, high, d)
            if _bit(key, d):
                siblings.append(self.node(low, mid, d + 1))
                low = mid
            else:
                siblings.append(self.node(mid, high, d + 1))
                high = mid
        return siblings, self.leaves[low] if low < high else None


def prefix_roots(leaves: DataFrame, digits: int = PREFIX_DIGITS, tree: list[str] = ()) -> DataFrame:
    """(tree, prefix, root) of every non-empty subtree below the first `digits` hex digits."""
    tree, depth = list(tree), 4 * digits
    group = [*tree, "prefix"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for pdf in _runs(batches, group):
            sub = _Subtree(pdf["key"].tolist(), pdf["leaf"].tolist())
            out.append((*[pdf[c].iloc[0] for c in group], sub.node(0, len(sub.keys), depth).hex()))
        yield pd.DataFrame(out, columns=[*group, "root"])

    keyed = leaves.select(*tree, F.substring("key", 1, digits).alias("prefix"), "key", "leaf")
    schema = ", ".join([f"`{c}` {leaves.schema[c].dataType.simpleString()}" for c in tree] + ["prefix string", "root string"])
    placed = keyed.repartition(task_count(leaves.sparkSession), *group).sortWithinPartitions(*group)
    return placed.mapInPandas(fold, schema)


def _runs(batches: Iterator[pd.DataFrame], group: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows of one group as one frame each, across batch borders."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        keys = list(zip(*[pdf[c] for c in group]))
        starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
        for a, b in zip(starts, starts[1:]):
            if held and tuple(held[-1][c].iloc[-1] for c in group) != keys[a]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(pdf.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True)


def combine(prefixes: DataFrame, digits: int = PREFIX_DIGITS, tree: list[str] = ()) -> DataFrame:
    """(tree, root) over prefix roots, one hex digit per round: at most 16 nodes meet in a group."""
    tree = list(tree)
    level = prefixes.select(*tree, "prefix", "root")
    for d in range(digits - 1, -1, -1):
        nodes = F.array_sort(F.collect_list(F.struct(F.conv(F.substring("prefix", d + 1, 1), 16, 10).cast("int").alias("i"), F.col("root").alias("h"))))
        level = level.groupBy(*tree, F.substring("prefix", 1, d).alias("prefix")).agg(nodes.alias("__n")).select(
            *tree, "prefix", _fold16(F.col("__n.i"), F.col("__n.h"), F.lit(SMT_DEPTH - 4 * (d + 1)))["root"].alias("root"))
    return level.select(*tree, "root")


def _sixteen(positions, hashes, height: int) -> list[list[bytes]]:
    """Levels over 16 slots whose absent ones are empty subtrees of `height`."""
    layer = [canon.EMPTY_ROOTS[height]] * 16
    for i, h in zip(positions, hashes):
        layer[int(i)] = bytes.fromhex(h)
    levels = [layer]
    while len(layer) > 1:
        layer = [canon.pair_digest(layer[i], layer[i + 1]) for i in range(0, len(layer), 2)]
        levels.append(layer)
    return levels


@pandas_udf(T.StructType([T.StructField("root", T.StringType()), T.StructField("siblings", T.ArrayType(T.ArrayType(T.StringType())))]))
def _fold16(positions: pd.Series, hashes: pd.Series, height: pd.Series) -> pd.DataFrame:
    roots, paths = [], []
    for p, h, up in zip(positions, hashes, height):
        levels = _sixteen(p, h, int(up))
        roots.append(levels[-1][0].hex())
        # For each of the 16 slots: its siblings from the top of this digit down.
        paths.append([[levels[k][(i >> k) ^ 1].hex() for k in (3, 2, 1, 0)] for i in range(16)])
    return pd.DataFrame({"root": roots, "siblings": paths})


def smt_root(leaves: DataFrame, digits: int = PREFIX_DIGITS, tree: list[str] = ()) -> DataFrame:
    """Root per tree; no leaves at all gives the empty-tree root (only for a single tree)."""
    roots = combine(prefix_roots(leaves, digits, tree), digits, tree)
    if tree:
        return roots
    return roots.agg(F.coalesce(F.max("root"), F.lit(canon.EMPTY_SMT_ROOT)).alias("root"))


def update_prefix_roots(previous: DataFrame, leaves: DataFrame, touched: DataFrame, digits: int = PREFIX_DIGITS,
                        tree: list[str] = ()) -> DataFrame:
    """Prefix roots after a change: only prefixes of touched keys are folded again.

    `leaves` are the current leaves (a deleted key is simply absent), `touched` the changed keys.
    """
    tree = list(tree)
    prefix = F.substring("key", 1, digits).alias("prefix")
    hit = touched.select(*tree, prefix).distinct()
    current = leaves.withColumn("prefix", F.substring("key", 1, digits)).join(hit, [*tree, "prefix"], "left_semi")
    fresh = prefix_roots(current.select(*tree, "key", "leaf"), digits, tree)
    return previous.join(hit, [*tree, "prefix"], "left_anti").select(*tree, "prefix", "root").unionByName(fresh)


def _upper_siblings(prefixes: DataFrame, wanted: DataFrame, digits: int) -> DataFrame:
    """(prefix, root, siblings of the first 4 x digits depths, top down) for the wanted prefixes."""
    asked = wanted.select(F.substring("key", 1, digits).alias("prefix")).distinct()
    out = asked.withColumn("__up", F.array().cast("array<string>"))
    level = prefixes.select("prefix", "root")
    for d in range(digits - 1, -1, -1):
        nodes = F.array_sort(F.collect_list(F.struct(F.conv(F.substring("prefix", d + 1, 1), 16, 10).cast("int").alias("i"), F.col("root").alias("h"))))
        folded = level.groupBy(F.substring("prefix", 1, d).alias("__head")).agg(nodes.alias("__n")).select(
            "__head", _fold16(F.col("__n.i"), F.col("__n.h"), F.lit(SMT_DEPTH - 4 * (d + 1))).alias("__f"))
        empty = [canon.EMPTY_ROOTS[SMT_DEPTH - 4 * (d + 1) + k].hex() for k in (3, 2, 1, 0)]
        slot = F.conv(F.substring("prefix", d + 1, 1), 16, 10).cast("int")
        own = F.coalesce(F.get(F.col("__f.siblings"), slot), F.array(*[F.lit(e) for e in empty]))
        joined = out.withColumn("__head", F.substring("prefix", 1, d)).join(folded, "__head", "left")
        out = joined.select("prefix", F.concat(own, "__up").alias("__up"), *([] if d else [F.col("__f.root").alias("root")]))
        level = folded.select(F.col("__head").alias("prefix"), F.col("__f.root").alias("root"))
    return out.withColumn("root", F.coalesce("root", F.lit(canon.EMPTY_SMT_ROOT)))


PROOF = "key string, leaf_value string, root string, bitmap string, siblings array<string>"


def smt_proofs(leaves: DataFrame, wanted: DataFrame, digits: int = PREFIX_DIGITS) -> DataFrame:
    """Compressed (non-)membership proof of each wanted key.

    `bitmap` has one bit per depth, most significant first; a clear bit means the sibling there
    is the empty subtree, a set bit takes the next entry of `siblings` (top down).
    """
    depth = 4 * digits
    asked = wanted.select("key").distinct()
    upper = _upper_siblings(prefix_roots(leaves, digits), asked, digits)
    local = leaves.withColumn("prefix", F.substring("key", 1, digits)).join(
        asked.select(F.substring("key", 1, digits).alias("prefix")).distinct(), "prefix", "left_semi")
    both = local.select("prefix", F.lit(0).alias("asked"), "key", "leaf").unionByName(
        asked.select(F.substring("key", 1, digits).alias("prefix"), F.lit(1).alias("asked"), "key"), allowMissingColumns=True).unionByName(
        upper.select("prefix", F.lit(2).alias("asked"), "root", "__up"), allowMissingColumns=True)  # once per prefix, not per key

    def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _runs(batches, ["prefix"]):
            have, ask, top = (pdf[pdf["asked"] == k] for k in (0, 1, 2))
            sub, out = _Subtree(have["key"].tolist(), have["leaf"].tolist()), []
            root, up = top["root"].iloc[0], [bytes.fromhex(s) for s in top["__up"].iloc[0]]
            for key in ask["key"]:
                lower, leaf = sub.path(bytes.fromhex(key), depth)
                bitmap, real = compress(up + lower)
                out.append((key, leaf.hex() if leaf else None, root, bitmap.hex(), [r.hex() for r in real]))
            if out:
                yield pd.DataFrame(out, columns=["key", "leaf_value", "root", "bitmap", "siblings"])

    placed = both.repartition(task_count(leaves.sparkSession), "prefix").sortWithinPartitions("prefix")
    return placed.mapInPandas(prove, PROOF)


def compress(siblings: list[bytes]) -> tuple[bytes, list[bytes]]:
    bits, real = bytearray(SMT_DEPTH // 8), []
    for d, (s, empty) in enumerate(zip(siblings, _EMPTY_BELOW[0])):
        if s is not empty and s != empty:
            bits[d >> 3] |= 1 << (7 - (d & 7))
            real.append(s)
    return bytes(bits), real


def decompress(bitmap: bytes, real: list[bytes]) -> list[bytes]:
    rest = iter(real)
    try:
        out = [next(rest) if _bit(bitmap, d) else canon.EMPTY_ROOTS[SMT_DEPTH - 1 - d] for d in range(SMT_DEPTH)]
    except StopIteration:
        raise ValueError("too few siblings in compressed proof") from None
    if next(rest, None) is not None:
        raise ValueError("surplus siblings in compressed proof")
    return out


@pandas_udf(T.BooleanType())
def verify_smt(root: pd.Series, key: pd.Series, leaf: pd.Series, bitmap: pd.Series, siblings: pd.Series) -> pd.Series:
    """Does a compressed proof lead to the root?  A NULL leaf verifies absence."""
    return pd.Series([_implied_root(k, v, b, x).hex() == r for r, k, v, b, x in zip(root, key, leaf, bitmap, siblings)])


def _implied_root(key: str, leaf: str | None, bitmap: str, siblings) -> bytes:
    """Root that a compressed proof gives; below its lowest real sibling a lone leaf or nothing at all is carried up."""
    marked, bits, raw = int(bitmap, 16), int(key, 16), [bytes.fromhex(x) for x in siblings]
    if marked.bit_count() != len(raw):
        raise ValueError(f"too {'few' if marked.bit_count() > len(raw) else 'many'} siblings in compressed proof")
    lowest = (marked & -marked).bit_length() - 1 if marked else SMT_DEPTH  # height of the lowest real sibling
    node = canon.EMPTY_ROOTS[lowest] if leaf is None else lifted(bytes.fromhex(key), bytes.fromhex(leaf), SMT_DEPTH - lowest)
    sha = hashlib.sha256
    for height in range(lowest, SMT_DEPTH):
        other = raw.pop() if marked >> height & 1 else canon.EMPTY_ROOTS[height]
        node = sha(_MARK + other + node if bits >> height & 1 else _MARK + node + other).digest()
    return node


# ---- stored nodes ------------------------------------------------------------------------------
def reachable_nodes(nodes: DataFrame, roots: DataFrame, max_levels: int = SMT_DEPTH + 1) -> DataFrame:
    """Stored nodes reachable from the roots, level by level; each level only joins its own frontier.

    Nodes are laid out by hash once and stay there, so a level shuffles the hashes that it asks for and no nodes; one
    lookup tells which of them are stored and what they point at.  The tree has at most 256 levels, so the loop is
    bounded; lineage is cut at every level.
    """
    empties = [e.hex() for e in canon.EMPTY_ROOTS]
    children = F.filter(F.array("left_hash", "right_hash"), lambda c: c.isNotNull() & ~c.isin(*empties))
    held = nodes.select("node_hash", children.alias("children")).repartition(part_count(nodes), "node_hash").sortWithinPartitions(
        "node_hash").persist(StorageLevel.DISK_ONLY)
    asked, seen = roots.select("node_hash").where(~F.col("node_hash").isin(*empties)).distinct(), None
    try:
        for _ in range(max_levels + 1):
            found = materialise(held.join(asked, "node_hash", "left_semi"))
            level = found.select("node_hash")
            seen = level if seen is None else seen.unionByName(level)
            if found.isEmpty():
                return seen.distinct()
            asked = found.select(F.explode("children").alias("node_hash")).distinct().join(seen, "node_hash", "left_anti")
    finally:
        held.unpersist()
    raise ValueError(f"nodes deeper than {max_levels} levels: not a tree of this depth")


def orphan_stats(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    total = nodes.agg(F.countDistinct("node_hash").alias("total_nodes"))
    reached = reachable_nodes(nodes, roots).agg(F.count("*")).scalar()
    return total.withColumn("reachable_nodes", reached).withColumn(
        "orphan_count", F.col("total_nodes") - F.col("reachable_nodes"))
