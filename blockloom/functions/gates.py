"""Height-gated features: activation rows joined by (coin, network) instead of branching code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.fixed_values import ACTIVATION_HEIGHTS, RESERVED_SUBTREES
from blockloom.functions.canon import strict_height

ESCROW_FEATURE = "escrow_locked_leaf"


def activation_height(feature: str, coin: str | None, network: str) -> int | None:
    heights = ACTIVATION_HEIGHTS[feature]
    if coin is not None and f"{coin}:{network}" in heights:
        return heights[f"{coin}:{network}"]
    return heights.get(network)


def activation_rows(spark: SparkSession) -> DataFrame:
    rows = [(f, k, int(v)) for f, m in ACTIVATION_HEIGHTS.items() for k, v in m.items()]
    return spark.createDataFrame(rows, "feature string, scope string, height bigint")


def is_active(feature: str, block: Column, coin: str | None, network: str) -> Column:
    """Plan-time lookup of the height; unknown scope or malformed height means off."""
    at = activation_height(feature, coin, network)
    if at is None:
        return F.lit(False)
    return F.coalesce(strict_height(block) >= F.lit(at), F.lit(False))


def is_boundary(feature: str, block: Column, coin: str | None, network: str) -> Column:
    """True only on the first active block."""
    return is_active(feature, block, coin, network) & ~is_active(feature, block - 1, coin, network)


def with_gate(df: DataFrame, activations: DataFrame, feature: str, out: str,
              block: str = "block_index", coin: str = "coin", network: str = "network") -> DataFrame:
    """Per-row gate when coin and network are columns: exact scope wins over the bare network.

    The heights of one feature are a handful of rows; they arrive as one map (a scalar subquery).
    """
    heights = activations.where(F.col("feature") == feature).agg(
        F.map_from_entries(F.collect_list(F.struct("scope", "height")))).scalar()
    known = df.withColumn("__heights", heights)
    pair = F.concat_ws(":", F.col(coin), F.col(network))
    height = F.coalesce(F.try_element_at("__heights", pair), F.try_element_at("__heights", F.col(network)))
    active = F.coalesce(strict_height(F.col(block)) >= height, F.lit(False))
    return known.withColumn(out, active).drop("__heights")


def gated_sub_roots(candidates: dict[str, Column], block: Column, coin: str, network: str) -> dict[str, Column]:
    """Keep a reserved slot's root only where the slot is active."""
    unknown = set(candidates) - set(RESERVED_SUBTREES)
    if unknown:
        raise ValueError(f"unknown sub-tree: {sorted(unknown)}")
    return {n: F.when(is_active(n, block, coin, network), c) for n, c in candidates.items()}


def state_root_version(block: Column, coin: str, network: str) -> Column:
    extended = is_active(ESCROW_FEATURE, block, coin, network)
    for n in RESERVED_SUBTREES:
        extended = extended | is_active(n, block, coin, network)
    return F.when(extended, 2).otherwise(1)
