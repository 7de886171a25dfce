"""Commitments of each height of a batch, recomputed from what landed: which block does not hold what it says.

A block's content root and hashes follow from its own rows.  The balances root as of a height follows from the
balances before the batch and the batch's own ledger rows up to that height: one task a key prefix threads
the heights in order, so no ledger is read and no height waits for another.  The state hash holds only while the
tables are as they were right after a block, so only the batch's last block can be asked for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.fixed_values import SMT_DEPTH
from blockloom.functions import canon
from blockloom.functions import decimals as D
from blockloom.operators import aggregates as agg
from blockloom.operators import integrity, merkle, scan, smt
from blockloom.operators.smt_store import Nodes
from blockloom.session import task_count


def balance_history(before: DataFrame, credits: DataFrame, debits: DataFrame, height: str = "block_index") -> DataFrame:
    """(address_id, tick_id, height, amount, amount_nonzero): the balance of each pair after each height that moves it.

    `before`: balances below all heights; the ledgers carry a height.  A pair has at most as many rows as it has heights here.
    """
    pair = agg.PAIR
    news = reduce(DataFrame.unionByName, [df.select(*pair, F.col(height).alias("__h"), "amount", F.lit(s).alias("sign")) for df, s in ((credits, 1), (debits, -1))])
    news = news.dropna(subset=pair)
    moments = news.select(*pair, F.col("__h").alias(height)).distinct()
    upto = moments.join(news, pair).where(F.col("__h") <= F.col(height)).select(*pair, height, "amount", "sign")
    was = moments.join(before.select(*pair, "amount"), pair).select(*pair, height, "amount", F.lit(1).alias("sign"))
    return D.exact_sum(upto.unionByName(was), [*pair, height], "amount", "amount", "sign")


def tree_roots_by_height(before: DataFrame, changes: DataFrame, heights: DataFrame, digits: int = smt.PREFIX_DIGITS) -> DataFrame:
    """(block_index, root) of the tree after each height.

    `before` (key, leaf) are the leaves below all heights, `changes` (block_index, key, leaf) their values from a height
    on, null where the key goes; one row per key and height.
    """
    depth = 4 * digits
    prefix = F.substring("key", 1, digits).alias("prefix")
    hit = changes.select(prefix).distinct()
    held = before.select(prefix, "key", "leaf")
    rows = held.join(hit, "prefix", "left_semi").withColumn("block_index", F.lit(None).cast("bigint")).unionByName(
        changes.select(prefix, "key", "leaf", F.col("block_index").cast("bigint").alias("block_index")))

    def thread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw = bytes.fromhex
        for pdf in smt._runs(batches, ["prefix"]):
            first = pdf[pdf["block_index"].isna()]
            nodes, out = Nodes({}, {}), []
            top = nodes.built(sorted((raw(k), raw(v)) for k, v in zip(first["key"], first["leaf"])), depth)
            for at, step in pdf[pdf["block_index"].notna()].groupby("block_index"):  # ascending
                top = nodes.updated(top, depth, sorted((raw(k), raw(v) if v else None) for k, v in zip(step["key"], step["leaf"])))
                out.append((pdf["prefix"].iloc[0], int(at), None if top == canon.EMPTY_ROOTS[SMT_DEPTH - depth] else top.hex()))
            yield pd.DataFrame(out, columns=["prefix", "since", "root"])

    placed = rows.repartition(task_count(before.sparkSession), "prefix").sortWithinPartitions("prefix")
    moved = placed.mapInPandas(thread, "prefix string, since bigint, root string")
    start = smt.prefix_roots(before, digits).select("prefix", F.lit(-1).cast("bigint").alias("since"), "root")
    wanted = heights.select(F.col("block_index").cast("bigint").alias("block_index")).distinct()
    ends = wanted.agg(F.min("block_index").alias("low"), F.max("block_index").alias("high"))
    # a prefix's root holds until its next one: as many rows as prefixes and heights of the batch make
    until = F.lead("since").over(Window.partitionBy("prefix").orderBy("since")) - 1
    spans = start.unionByName(moved).withColumn("until", F.coalesce(until, ends.select("high").scalar())).withColumn(
        "since", F.greatest("since", ends.select("low").scalar())).where("root is not null and since <= until")
    now = spans.select("prefix", "root", F.explode(F.sequence("since", "until")).alias("block_index")).join(wanted, "block_index", "left_semi")
    found = smt.combine(now, digits, ["block_index"])
    return wanted.join(found, "block_index", "left").select("block_index", F.coalesce("root", F.lit(canon.EMPTY_SMT_ROOT)).alias("root"))


def balances_roots(before: DataFrame, landed: dict[str, DataFrame], low: int, high: int, chain: str, network: str, digits: int = smt.PREFIX_DIGITS) -> DataFrame:
    """(block_index, balances_root) of each landed height; `before` are the balances below `low`."""
    own = landed["actions"].where(F.col("block_index").between(low, high)).select("action_index", "block_index")
    moved = balance_history(before, *[landed[t].join(own, "action_index") for t in ("credits", "debits")])

    def named(df: DataFrame) -> DataFrame:
        out = scan.resolve(df, landed["index_addresses"], "address_id", "address", "address")
        out = scan.resolve(out, landed["index_tickers"], "tick_id", "tick", "tick").where("address is not null and tick is not null")
        return out.withColumn("key", canon.balance_key(F.lit(chain), F.lit(network), F.col("address"), F.col("tick")))

    leaves = named(before).select("key", canon.amount_leaf(F.col("amount")).alias("leaf"))
    changes = named(moved).select("block_index", "key", F.when(F.col("amount_nonzero"), canon.amount_leaf(F.col("amount"))).alias("leaf"))
    heights = landed["blocks"].where(F.col("block_index").between(low, high))
    return tree_roots_by_height(leaves, changes, heights, digits).withColumnRenamed("root", "balances_root")


def mismatches(before: dict[str, DataFrame], landed: dict[str, DataFrame], low: int, high: int, chain: str | None = None, network: str = "mainnet",
               delay: int | None = None, digits: int = smt.PREFIX_DIGITS) -> DataFrame:
    """(block_index, field, computed, committed) of every commitment of the heights low..high that the landed rows don't give.

    Only what the blocks carry is asked: the three hashes, and with a `chain` also block_merkle_root, balances_root and,
    of the last height, state_hash.  A commitment that is null is not asked.
    """
    blocks = landed["blocks"]
    window = blocks.where(F.col("block_index").between(low - 1, high))
    own = blocks.where(F.col("block_index").between(low, high))
    parts = []
    binary = integrity.key_collation(chain, network) if chain is not None else True
    hashes = ["ledger_hash", "actions_hash", "contract_hash"]
    if set(hashes) <= set(blocks.columns):
        computed = integrity.block_hashes(landed, window, binary).where(F.col("block_index") >= low)
        parts.append(integrity.compare_roots(computed, window, hashes))
    if chain is not None and "block_merkle_root" in blocks.columns:
        parts.append(integrity.compare_roots(merkle.block_merkle_roots(landed, own, binary), own, ["block_merkle_root"]))
    if chain is not None and "balances_root" in blocks.columns and "balances" in before:
        parts.append(integrity.compare_roots(balances_roots(before["balances"], landed, low, high, chain, network, digits), own, ["balances_root"]))
    if chain is not None and "state_hash" in blocks.columns:
        last = own.where(F.col("block_index") == high)
        parts.append(integrity.compare_roots(integrity.state_hashes(landed, last, delay, chain, network), last, ["state_hash"]))
    if not parts:
        return blocks.sparkSession.createDataFrame([], "block_index bigint, field string, computed string, committed string")
    return reduce(DataFrame.unionByName, parts)
