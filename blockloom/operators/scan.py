"""Scans, paging, filters and set operations over ledger tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.fixed_values import LOG_PAGE_MAX, PAGE_DEFAULT, PAGE_MAX, ADDRESS_ROLES


# ---- windows -----------------------------------------------------------------------------------
def in_window(column: str | Column, start: int, end: int, offset: int = 0) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return col.between(start + offset, end + offset)


def block_scan(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.where(in_window("block_index", start, end))


def action_scan(df: DataFrame, actions: DataFrame, start: int, end: int) -> DataFrame:
    """Rows whose action sits in the window; scoped by the action's own height, so rows of
    protocol-made actions (no transaction) stay in."""
    scoped = actions.where(in_window("block_index", start, end)).select("action_index")
    return df.join(scoped, "action_index", "left_semi")


def tx_scan(df: DataFrame, transactions: DataFrame, start: int, end: int) -> DataFrame:
    scoped = transactions.where(in_window("block_index", start, end)).select("tx_index")
    return df.join(scoped, "tx_index", "left_semi")


def emission_scan(emissions: DataFrame, executions: DataFrame, actions: DataFrame,
                  start: int, end: int) -> DataFrame:
    """Child rows reached through their execution's action; only the protocol columns travel."""
    runs = action_scan(executions, actions, start, end).select(F.col("action_index").alias("execution_index"))
    return emissions.join(runs, "execution_index", "left_semi").select(
        "execution_index", "emitted_action", "action_index", "position")


def first_action(actions: DataFrame, height: int) -> DataFrame:
    """One row: lowest action index at or above the height, NULL when there is none."""
    return actions.where(F.col("block_index") >= height).agg(F.min("action_index").alias("first_action_index"))


def nonempty_tables(tables: dict[str, DataFrame], actions: DataFrame, start: int, end: int) -> DataFrame:
    """Which tables hold rows in the window, in one job; each branch is pre-aggregated to a row."""
    scoped = actions.where(in_window("block_index", start, end)).select("action_index")
    probes = [
        df.select("action_index").join(scoped, "action_index", "left_semi")
          .agg(F.count("*").alias("n_rows")).where("n_rows > 0")
          .select(F.lit(name).alias("table"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, probes)


# ---- paging ------------------------------------------------------------------------------------
def id_page(df: DataFrame, after: int, limit: int = PAGE_DEFAULT, key: str = "id") -> DataFrame:
    """One page of an append-only lookup above a cursor, with `max_id` and `has_more` (page full)."""
    size = max(1, min(limit, PAGE_MAX))
    page = df.where(F.col(key) > after).orderBy(key).limit(size)
    whole = Window.partitionBy()  # at most `size` rows, bounded by PAGE_MAX
    return page.withColumns({
        "max_id": F.max(key).over(whole),
        "has_more": F.count("*").over(whole) == size,
    })


def keyset_page(df: DataFrame, keys: list[str], after: list, limit: int) -> DataFrame:
    """Page behind a composite cursor; every key but the last breaks ties by the next."""
    beyond: Column = F.lit(False)
    for key, value in reversed(list(zip(keys, after))):
        beyond = (F.col(key) > F.lit(value)) | ((F.col(key) == F.lit(value)) & beyond)
    return df.where(beyond).orderBy(*keys).limit(limit)


def log_page(log: DataFrame, page: int, limit: int, columns: list[str], bucket: int = 10_000) -> DataFrame:
    """Page of the log, newest first, each row carrying the total.

    Heights are counted by bucket, so a deep page reads and orders the buckets it lies in, not all that come before it.
    """
    size = min(LOG_PAGE_MAX, max(1, limit))
    first = max(0, page) * size
    at = F.floor(F.col("block_index") / bucket)
    counts = log.groupBy(at.alias("__bucket")).agg(F.count("*").alias("__n"))
    newer = Window.orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    hit = counts.withColumn("__before", F.coalesce(F.sum("__n").over(newer), F.lit(0))).where(
        (F.col("__before") < first + size) & (F.col("__before") + F.col("__n") > first)).select("__bucket", "__before")
    inside = Window.partitionBy("__bucket").orderBy(F.desc("block_index"))
    placed = log.withColumn("__bucket", at).join(hit, "__bucket").withColumn("__at", F.col("__before") + F.row_number().over(inside) - 1)
    rows = placed.where(F.col("__at").between(first, first + size - 1)).orderBy(F.desc("block_index")).select(*columns)
    return rows.withColumn("total", log.agg(F.count("*")).scalar())


# ---- lookups -----------------------------------------------------------------------------------
def referenced_ids(frames: list[DataFrame]) -> DataFrame:
    """Every distinct non-null value found in any `*_id` column."""
    parts = []
    for df in frames:
        cols = [c for c in df.columns if c.endswith("_id")]
        if cols:
            ids = F.array(*[F.col(c).cast("bigint") for c in cols])
            parts.append(df.select(F.explode(ids).alias("id")).where("id is not null").distinct())
    return reduce(DataFrame.union, parts).distinct()


def referenced_lookups(frames: list[DataFrame], lookups: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Lookup rows any payload row may point at; over-fetch is harmless, a miss is not."""
    ids = referenced_ids(frames)
    return {name: df.join(ids, "id", "left_semi") for name, df in lookups.items()}


def first_references(frames: list[DataFrame], height: str) -> DataFrame:
    """Every non-null value of any `*_id` column, with the lowest height of a row that holds it."""
    parts = []
    for df in frames:
        cols = [c for c in df.columns if c.endswith("_id")]
        if cols:
            ids = F.explode(F.array(*[F.col(c).cast("bigint") for c in cols]))
            parts.append(df.select(ids.alias("id"), height).where("id is not null").groupBy("id").agg(F.min(height).alias(height)))
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.min(height).alias(height))


def resolve(df: DataFrame, lookup: DataFrame, id_col: str, text_col: str, out: str) -> DataFrame:
    """Left lookup of an interned id; the optimizer broadcasts the lookup only when it is small."""
    names = lookup.select(F.col("id").alias(id_col), F.col(text_col).alias(out))
    return df.join(names, id_col, "left")


def canonical_role(address: Column) -> Column:
    """Protocol address -> role token; other addresses and NULL unchanged."""
    pairs = [F.lit(x) for pair in ADDRESS_ROLES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), address), address)


def canonical_role_by_table(df: DataFrame, roles: DataFrame, column: str) -> DataFrame:
    """Same with a caller-supplied role table (`address`, `role`)."""
    known = roles.select(F.col("address").alias(column), "role")
    return (df.join(known, column, "left")
              .withColumn(column, F.coalesce("role", F.col(column))).drop("role").select(*df.columns))


def status_id_rows(statuses: DataFrame, *names: str) -> DataFrame:
    """Status rows by name; joining them replaces a scalar lookup, an unknown name joins nothing."""
    return statuses.where(F.col("status").isin(*names))


# ---- predicates --------------------------------------------------------------------------------
def project_tables(changes: DataFrame, tables: list[str]) -> DataFrame:
    return changes.where(F.col("table").isin(*tables))


def exclude_tables(changes: DataFrame, tables: list[str]) -> DataFrame:
    return changes.where(~F.col("table").isin(*tables))


def schema_gate(payload: DataFrame, expected: int) -> DataFrame:
    """Raise on any payload row of another schema version."""
    return payload.where(F.when(F.col("schema_version") == expected, F.lit(True)).otherwise(
        F.raise_error(F.lit("schema version mismatch"))))


def skip_applied(payload: DataFrame, applied: DataFrame) -> DataFrame:
    return payload.join(applied.select("block_index"), "block_index", "left_anti")


NUMERIC = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"


def bad_weight(source: Column, weight: Column) -> Column:
    """Fail-closed guard: blank source, missing, non-numeric or negative weight."""
    text = F.trim(weight.cast("string"))
    return (
        source.isNull() | (F.trim(source.cast("string")) == "") | weight.isNull()
        | ~F.coalesce(text.rlike(NUMERIC), F.lit(False)) | (text.startswith("-") & text.rlike("[1-9]"))
    )


def event_reason(kind: Column, block_index: Column, block_height: Column) -> Column:
    """Why a stream event is refused; NULL means it may pass."""
    whole = lambda c: F.coalesce(c.cast("string").rlike("^[0-9]+$"), F.lit(False))
    finite = F.coalesce(block_height.cast("string").rlike(r"^-?[0-9]+([.][0-9]+)?$"), F.lit(False))
    return (
        F.when(kind.isNull() | ~kind.isin("block", "reorg", "status"), "unknown type")
        .when(kind.isin("block", "reorg") & ~whole(block_index), "block_index must be a whole number >= 0")
        .when((kind == "status") & block_height.isNotNull() & ~finite, "block_height must be finite")
    )


# ---- sets --------------------------------------------------------------------------------------
def merge_side_channel(base: DataFrame, extra: DataFrame, identity: list[str]) -> DataFrame:
    """Every base row stays, keyless duplicates included; an extra row joins only when its
    identity is in neither the base nor an earlier extra (rows of one identity are equal)."""
    held = base.select(*[F.col(c).alias(f"__held_{c}") for c in identity]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"__held_{c}")) for c in identity]  # NULL is one value here
    fresh = extra.dropDuplicates(identity).join(held, same, "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def missing_tables(expected: DataFrame, present: DataFrame) -> DataFrame:
    return expected.select("table").join(present.select("table"), "table", "left_anti").distinct()


def schema_rows(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    return [(n, f.name, f.dataType.simpleString()) for n, df in tables.items() for f in df.schema.fields]


def schema_diff(source: DataFrame, replica: DataFrame) -> DataFrame:
    """Columns to add, kept extra, or differing in type between two (`table`,`column`,`type`) sets."""
    s = source.select("table", "column", F.col("type").alias("source_type"))
    r = replica.select("table", "column", F.col("type").alias("replica_type"))
    change = (
        F.when(F.col("replica_type").isNull(), "add")
        .when(F.col("source_type").isNull(), "replica only")
        .when(F.col("source_type") != F.col("replica_type"), "type differs")
    )
    return s.join(r, ["table", "column"], "full_outer").withColumn("change", change).where("change is not null")


def evolve(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Additive evolution: columns either side lacks come back as NULL."""
    return existing.unionByName(incoming, allowMissingColumns=True)


def config_merge(base: DataFrame, delta: DataFrame, full_replace: bool = False) -> DataFrame:
    """Last writer wins per (coin, network, module, param); without a watermark the delta is everything."""
    if full_replace:
        return delta
    keys = ["coin", "network", "module", "param"]
    both = base.withColumn("__late", F.lit(0)).unionByName(delta.withColumn("__late", F.lit(1)))
    newest = F.max_by(F.struct("value", "updated_at"), F.struct("__late", "updated_at", "value"))
    return both.groupBy(*keys).agg(newest.alias("__v")).select(*keys, "__v.value", "__v.updated_at")
