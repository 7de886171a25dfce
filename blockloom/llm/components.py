"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.session import materialise, prepare


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _star(sides: DataFrame, keep_self: bool) -> DataFrame:
    """Link each node's neighbours to the least node among them; `sides` is (u, v)."""
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    met = sides.join(least, F.col("u") == F.col("c"))
    if keep_self:  # small star: neighbours are all smaller
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
    else:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return _ordered(out)


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of the links (a, b), longs.

    Each round makes every node's larger neighbours, then its smaller ones, point at the least of
    them; the number of rounds grows with the logarithm of the longest path.  Minima are taken in
    partial sums before a shuffle, and Spark splits the join of a node with very many links.
    """
    prepare(links.sparkSession)
    edges, before = materialise(_ordered(links)), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, False)
        edges = materialise(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), True))
