"""Balances, supplies, counts and latest-value aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions import decimals as D

PAIR = ["address_id", "tick_id"]


def signed_ledger(credits: DataFrame, debits: DataFrame, escrows: DataFrame | None = None,
                  keys: list[str] = PAIR) -> DataFrame:
    """Ledger branches as one bag with a sign; nothing is deduplicated."""
    parts = [credits.select(*keys, "amount", F.lit(1).alias("sign")),
             debits.select(*keys, "amount", F.lit(-1).alias("sign"))]
    if escrows is not None:
        parts.append(escrows.select(*keys, "amount", F.lit(1).alias("sign")))
    return reduce(DataFrame.unionByName, parts)


def balances(credits: DataFrame, debits: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Exact credits minus debits per key; zero balances are pruned."""
    net = D.exact_sum(signed_ledger(credits, debits, keys=keys), keys, "amount", "amount", "sign")
    return net.where("amount_nonzero").drop("amount_nonzero")


def net_balance(credits: DataFrame, debits: DataFrame, wanted: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Net of every wanted key, '0' where the ledger has no row."""
    asked = wanted.select(*keys).distinct()
    scoped = signed_ledger(credits, debits, keys=keys).join(asked, keys, "left_semi")
    net = D.exact_sum(scoped, keys, "amount", "net", "sign").drop("net_nonzero")
    return asked.join(net, keys, "left").withColumn("net", F.coalesce("net", F.lit("0")))


def balances_scoped(existing: DataFrame, credits: DataFrame, debits: DataFrame, touched: DataFrame,
                    keys: list[str] = PAIR) -> DataFrame:
    """Rebuild only the touched keys and keep the rest; equals a full rebuild.

    Keys are picked from the sums: Spark moves the pick below the sum where the touched keys are few enough to be sent
    to all tasks, and where they aren't, sums are shuffled rather than rows.
    """
    asked = touched.select(*keys).distinct()
    fresh = balances(credits, debits, keys).join(asked, keys, "left_semi")
    return existing.join(asked, keys, "left_anti").unionByName(fresh)


def balances_moved(existing: DataFrame, credits: DataFrame, debits: DataFrame, touched: DataFrame,
                   keys: list[str] = PAIR) -> DataFrame:
    """Balances of the touched keys after some new ledger rows: what they were plus the exact sum of the news, so the
    ledger itself isn't read.  Equals a rebuild where `existing` did; zero balances are pruned."""
    asked = touched.select(*keys).distinct()
    was = existing.join(asked, keys, "left_semi").select(*keys, "amount")
    news = [df.join(asked, keys, "left_semi").select(*keys, "amount") for df in (credits, debits)]
    return balances(was.unionByName(news[0]), news[1], keys)


def token_supplies(tokens: DataFrame, credits: DataFrame, debits: DataFrame, escrows: DataFrame) -> DataFrame:
    """Supply per token: (credits - debits) + escrows, summed at 18 digits, rounded once to the
    token's decimals (clamped to 0..18), minimal text; no ledger row means '0'."""
    ledger = signed_ledger(credits, debits, escrows, keys=["tick_id"])
    summed = D.with_limbs(ledger, "amount", "__s", "sign").groupBy("tick_id").agg(*D.limb_sums("__s"))
    joined = tokens.drop("supply").join(summed, "tick_id", "left")
    settled = D.settle(joined, "__s")
    rounded = D.round_settled(settled, "__s", f"greatest(0, least({D.SCALE}, coalesce(decimals, 0)))")
    kept = [c for c in tokens.columns if c != "supply"]
    return rounded.select(*kept, D.minimal_text("__s").alias("supply"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table"), "n_rows")
             for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def height_bounds(df: DataFrame, column: str = "block_index") -> DataFrame:
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def touched_keys(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    parts = [f.select(*keys).dropna().distinct() for f in frames]
    return reduce(DataFrame.union, parts).distinct()


def latest_per_key(journal: DataFrame, keys: list[str], value: str, order: str = "id",
                   as_of: int | None = None, keep_tombstones: bool = False) -> DataFrame:
    """Value of the highest id per key, tombstones included in the ranking and filtered after."""
    seen = journal if as_of is None else journal.where(F.col("block_index") <= as_of)
    newest = F.max_by(F.struct(F.col(value).alias("v"), F.col(order).alias("o")), F.col(order))
    out = seen.groupBy(*keys).agg(newest.alias("__n")).select(
        *keys, F.col("__n.v").alias(value), F.col("__n.o").alias(order))
    return out if keep_tombstones else out.where(F.col(value).isNotNull())


def as_of_many(journal: DataFrame, probes: DataFrame, keys: list[str], value: str,
               order: str = "id", bucket: int = 1_000) -> DataFrame:
    """As-of value of each (keys, block_index) probe: highest id at or below the probe's height.

    The journal is first reduced to one row per key and height.  A key's heights are cut into buckets that run on
    their own; only one row per bucket of a key meets its others, to carry what earlier buckets ended with.
    """
    per_height = journal.groupBy(*keys, "block_index").agg(
        F.max(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("__e"))
    asked = probes.select(*keys, "block_index", F.lit(1).alias("__probe"))
    both = per_height.withColumn("__probe", F.lit(0)).unionByName(asked, allowMissingColumns=True).withColumn(
        "__bucket", F.floor(F.col("block_index") / bucket))
    upto = Window.partitionBy(*keys, "__bucket").orderBy("block_index").rangeBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("__best", F.max("__e").over(upto)).where("__probe = 1").alias("n")
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(*keys, "__bucket").agg(F.max("__e").alias("__last")).withColumn("__carry", F.max("__last").over(earlier)).alias("c")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "__bucket")]
    best = F.greatest(F.col("n.__best"), F.col("c.__carry"))
    return near.join(ends, same, "left").select(*[F.col(f"n.{k}").alias(k) for k in (*keys, "block_index")], best["v"].alias(value))


def latest_in_block(journal: DataFrame, group: list[str], key: str, value: str, binary: bool | Column = True) -> DataFrame:
    """Latest journal row per (block, group, key); `binary=False` folds letter case when grouping, and a column
    decides row by row.  The row that wins keeps its own spelling of the key."""
    if isinstance(binary, Column):
        folded = F.when(binary, F.col(key)).otherwise(F.lower(key))
    else:
        folded = F.col(key) if binary else F.collate(F.col(key), "UTF8_LCASE")
    newest = F.max_by(F.struct(F.col(key).alias("k"), F.col(value).alias("v")), F.col("id"))
    keyed = journal.withColumn("__key", folded)
    return keyed.groupBy("block_index", *group, "__key").agg(newest.alias("__n")).select(
        "block_index", *group, F.col("__n.k").alias(key), F.col("__n.v").alias(value))


def mismatch_counters(mismatches: DataFrame, keys: list[str], name: str = "table", kept: int = 20) -> DataFrame:
    """Durable counters: how many, last height, and the first names in order.

    Names are reduced to distinct (key, name) pairs first and ranked, so no list outgrows `kept`.
    """
    totals = mismatches.groupBy(*keys).agg(
        F.count("*").alias("n_mismatches"), F.max("block_index").alias("last_block"))
    ranked = mismatches.select(*keys, name).distinct().withColumn(
        "__r", F.row_number().over(Window.partitionBy(*keys).orderBy(name))).where(F.col("__r") <= kept)
    names = ranked.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(name)), ",").alias("names"))
    return totals.join(names, keys, "left")
