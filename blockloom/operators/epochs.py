"""Epoch log: append, Merkle roots, inclusion proofs, gaps, pruning, retention.

An epoch holds at most `size` heights (the log has one row per height), so its leaves fit one
array and every level is folded by higher-order functions inside the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.fixed_values import EPOCH_SIZE
from blockloom.functions.canon import log_leaf, log_pair
from blockloom.operators.apply import insert_ignore

EPOCH_COLUMNS = ["epoch", "start_block", "end_block", "merkle_root", "leaf_count"]


def epoch_of(block: Column, size: int = EPOCH_SIZE) -> Column:
    """Epoch a height belongs to; height 0 and below belong to none."""
    return F.when(block >= 1, F.ceil(block / size)).cast("bigint")


def record(log: DataFrame, new: DataFrame) -> DataFrame:
    """Append heights; a height already logged keeps its row."""
    return insert_ignore(log, new, ["block_index"])


def leaves(log: DataFrame, size: int = EPOCH_SIZE) -> DataFrame:
    """(epoch, block_index, leaf) of every logged height inside an epoch."""
    leaf = log_leaf(F.col("ledger_hash"), F.col("actions_hash"), F.col("contract_hash"))
    return log.select(epoch_of(F.col("block_index"), size).alias("epoch"), "block_index", leaf.alias("leaf")).where(
        "epoch is not null")


def _next_layer(layer: Column) -> Column:
    half = F.ceil(F.size(layer) / 2).cast("int")
    at = lambda i: F.get(layer, i.cast("int"))
    pair = lambda i: log_pair(at(i * 2), F.coalesce(at(i * 2 + 1), at(i * 2)))
    return F.when(F.size(layer) <= 1, layer).otherwise(F.transform(F.sequence(F.lit(0), half - 1), pair))


def _layers(row: Column, size: int) -> Column:
    """All levels of the tree over an array of leaves; an odd node pairs with itself."""
    steps = F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(max(2, size))))))
    start = F.array(row).cast("array<array<string>>")
    grow = lambda acc, _: F.when(
        F.size(F.element_at(acc, -1)) <= 1, acc).otherwise(F.concat(acc, F.array(_next_layer(F.element_at(acc, -1)))))
    return F.aggregate(steps, start, grow)




def _epoch_arrays(log: DataFrame, size: int) -> DataFrame:
    per_height = leaves(log, size).groupBy("epoch", "block_index").agg(F.min("leaf").alias("leaf"))
    return per_height.groupBy("epoch").agg(F.array_sort(F.collect_list(F.struct("block_index", "leaf"))).alias("__l"))


def roots(log: DataFrame, size: int = EPOCH_SIZE, high_water: int | None = None) -> DataFrame:
    """Committed epochs: those whose last height is at or below the log's high water."""
    last = F.lit(high_water) if high_water is not None else log.agg(F.max("block_index")).scalar()
    arrays = _epoch_arrays(log, size).where(F.col("epoch") * size <= last)
    root = F.element_at(F.element_at(_layers(F.col("__l.leaf"), size), -1), 1)
    return arrays.select(
        "epoch", F.element_at("__l", 1)["block_index"].alias("start_block"),
        F.element_at("__l", -1)["block_index"].alias("end_block"), root.alias("merkle_root"),
        F.size("__l").cast("bigint").alias("leaf_count"))


def commit(epochs: DataFrame, log: DataFrame, size: int = EPOCH_SIZE) -> DataFrame:
    """Add newly complete epochs; one already committed is left alone."""
    fresh = roots(log, size)
    return epochs.unionByName(fresh.join(epochs.select("epoch"), "epoch", "left_anti"))


def recommit(epochs: DataFrame, log: DataFrame, affected: DataFrame, size: int = EPOCH_SIZE) -> DataFrame:
    """Rebuild the affected epochs that are complete; leave the rest."""
    last = log.agg(F.max("block_index")).scalar()
    due = affected.select("epoch").distinct().where(F.col("epoch") * size <= last)
    rows = log.withColumn("epoch", epoch_of(F.col("block_index"), size)).join(due, "epoch", "left_semi").drop("epoch")
    # `rows` ends below the log's tip, so completeness is judged by `due`, not by its own maximum.
    rebuilt = roots(rows, size, high_water=2**62).select(*EPOCH_COLUMNS)
    return epochs.select(*EPOCH_COLUMNS).join(due, "epoch", "left_anti").unionByName(rebuilt)


def proofs(log: DataFrame, epochs: DataFrame, size: int = EPOCH_SIZE) -> DataFrame:
    """Inclusion proof of every height of every committed epoch.

    `error` is set instead of a proof when the epoch is not committed or its leaves no longer
    match the committed count; `verified` re-derives the committed root from the proof.
    """
    arrays = _epoch_arrays(log, size).join(
        epochs.select("epoch", "merkle_root", F.col("leaf_count").cast("bigint").alias("leaf_count")), "epoch", "left")
    error = (F.when(F.col("merkle_root").isNull(), "epoch not yet committed")
             .when(F.size("__l") != F.col("leaf_count"), "epoch leaves incomplete"))
    built = arrays.withColumn("error", error).withColumn("__layers", F.when(
        F.col("error").isNull(), _layers(F.col("__l.leaf"), size)))
    rows = built.select("epoch", "merkle_root", "error", "__layers", F.posexplode("__l").alias("position", "__leaf"))
    below_top = F.slice("__layers", 1, F.size("__layers") - 1)

    def sibling(layer: Column, level: Column) -> Column:
        at = F.expr("position") if level is None else F.floor(F.col("position") / F.pow(F.lit(2), level)).cast("int")
        right = at % 2 == 1
        own = F.get(layer, at)
        other = F.coalesce(F.get(layer, F.when(right, at - 1).otherwise(at + 1)), own)
        return F.struct(other.alias("hash"), F.when(right, "left").otherwise("right").alias("position"))

    proof = F.when(F.col("error").isNull(), F.transform(below_top, sibling))
    shown = rows.select("epoch", F.col("__leaf.block_index").alias("block_index"), "position", F.col("__leaf.leaf").alias("leaf"),
                        "merkle_root", "error", proof.alias("proof"))
    return shown.withColumn("verified", verify(F.col("leaf"), F.col("proof"), F.col("merkle_root")))


def verify(leaf: Column, proof: Column, root: Column) -> Column:
    """Does a log proof (array of sibling hash and side) lead from the leaf to the root?"""
    step = lambda acc, s: F.when(s["position"] == "left", log_pair(s["hash"], acc)).otherwise(log_pair(acc, s["hash"]))
    return F.coalesce(F.aggregate(proof, leaf, step) == root, F.lit(False))


def gaps(log: DataFrame, blocks: DataFrame) -> DataFrame:
    """Source heights strictly inside the log's range that the log lacks."""
    low, high = log.agg(F.min("block_index")).scalar(), log.agg(F.max("block_index")).scalar()
    inside = blocks.select("block_index").distinct().where((F.col("block_index") > low) & (F.col("block_index") < high))
    return inside.join(log.select("block_index"), "block_index", "left_anti")


def backfill(log: DataFrame, epochs: DataFrame, source: DataFrame, size: int = EPOCH_SIZE) -> tuple[DataFrame, DataFrame]:
    """Log with its interior holes filled from the source, and epochs with the touched ones rebuilt."""
    holes = gaps(log, source)
    filled = record(log, source.join(holes, "block_index", "left_semi").select(*log.columns))
    touched = holes.select(epoch_of(F.col("block_index"), size).alias("epoch")).where("epoch is not null").distinct()
    return filled, recommit(epochs, filled, touched, size)


def prune_from(log: DataFrame, epochs: DataFrame, markers: DataFrame, height: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log, epochs, reorg markers) after a reorg to `height`: one pending marker per invalidated epoch."""
    lost = epochs.where(F.col("end_block") >= height)
    pending = markers.where("new_root is null").select("epoch").distinct()
    fresh = lost.join(pending, "epoch", "left_anti").select(
        F.lit(height).cast("bigint").alias("reorg_block"), "epoch", "start_block", "end_block",
        F.col("merkle_root").alias("old_root"), F.lit(None).cast("string").alias("new_root"))
    return (log.where(F.col("block_index") < height), epochs.where(F.col("end_block") < height),
            markers.unionByName(fresh))


def resolve_markers(markers: DataFrame, epochs: DataFrame) -> DataFrame:
    """Fill the replacement root of pending markers whose epoch was committed again."""
    now = epochs.select("epoch", F.col("merkle_root").alias("__r"))
    joined = markers.join(now, "epoch", "left")
    return joined.withColumn("new_root", F.coalesce("new_root", "__r")).select(*markers.columns)


def marker_chain(prunes: DataFrame, commits: DataFrame) -> DataFrame:
    """Reorg markers of a whole history: (seq, epoch, old_root, new_root) for each invalidation of a committed epoch.

    `prunes`: seq, epoch, old_root of every epoch each reorg invalidates; `commits`: seq, epoch, merkle_root.  A marker is
    completed by its epoch's next commit; while one is pending, further prunes of the epoch add none, since the epoch
    was not committed in between.
    """
    events = prunes.select("epoch", "seq", F.lit(1).alias("__prune"), "old_root", F.lit(None).cast("string").alias("__root")).unionByName(
        commits.select("epoch", "seq", F.lit(0).alias("__prune"), F.lit(None).cast("string").alias("old_root"), F.col("merkle_root").alias("__root")))
    by_epoch = Window.partitionBy("epoch").orderBy("seq", "__prune")  # an epoch has as many events as it was reorganised
    later = by_epoch.rowsBetween(1, Window.unboundedFollowing)
    told = events.withColumns({"__before": F.lag("__prune").over(by_epoch), "new_root": F.first("__root", ignorenulls=True).over(later)})
    return told.where((F.col("__prune") == 1) & ~F.col("__before").eqNullSafe(F.lit(1))).select("seq", "epoch", "old_root", "new_root")


def retention_boundary(log: DataFrame, epochs: DataFrame, keep: int) -> DataFrame:
    """One row: tip, cutoff, boundary (last committed end at or below the cutoff), straddling epochs,
    and whether pruning may go ahead."""
    tip = log.agg(F.max("block_index").alias("tip"))
    cut = F.col("tip") - keep
    bound = epochs.where(F.col("end_block") <= log.agg(F.max("block_index") - keep).scalar()).agg(F.max("end_block")).scalar()
    facts = tip.withColumns({"cutoff": F.when(cut >= 1, cut), "boundary": bound})
    facts = facts.withColumn("boundary", F.when(F.col("cutoff").isNotNull() & (F.col("boundary") >= 1), F.col("boundary")))
    crossing = epochs.where((F.col("start_block") <= bound) & (F.col("end_block") > bound)).agg(F.count("*")).scalar()
    return facts.withColumn("straddling", crossing).withColumn(
        "prune", F.col("boundary").isNotNull() & (F.col("straddling") == 0))


def retain(log: DataFrame, epochs: DataFrame, keep: int) -> DataFrame:
    """Log without the heights at or below the boundary; epochs themselves stay."""
    facts = retention_boundary(log, epochs, keep)
    limit = facts.select(F.when(F.col("prune"), F.col("boundary"))).scalar()
    return log.where(F.col("block_index") > F.coalesce(limit, F.lit(-(2**62))))


def latest_root(epochs: DataFrame) -> DataFrame:
    return epochs.orderBy(F.desc("epoch")).limit(1)


def latest_per_height(checkpoints: DataFrame, start: int, end: int, limit: int) -> DataFrame:
    """Newest checkpoint of each height in a range, lowest heights first."""
    newest = F.max_by(F.struct(*[c for c in checkpoints.columns if c != "block_index"]), F.col("checkpoint_seq"))
    rows = checkpoints.where(F.col("block_index").between(start, end)).groupBy("block_index").agg(newest.alias("__c"))
    return rows.select("block_index", "__c.*").orderBy("block_index").limit(limit)
