"""Snapshots: export, checked load, bootstrap whole or from a depth, and reconciliation of tables whose rows expire.

An export writes parts, then digests of what it wrote, then a marker that names both; a folder without a
marker is no snapshot, and a loaded one is compared with its digests before it is used.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from blockloom.operators import apply as ap
from blockloom.operators import integrity, scan
from blockloom.session import prepare
from blockloom.sources import versions
from blockloom.sources.versions import Delta, Staged

MARKER = "_SNAPSHOT.json"


class DamagedSnapshot(RuntimeError):
    """Unpublished, incomplete, or not what its digests say."""


# ---- export and load -----------------------------------------------------------------------------
def snapshot_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Eligible tables with export position, rows and digest, in one job over all of them."""
    listed = [(rank, name) for rank, name, _ in ap.full_snapshot(tables)]
    spark = next(iter(tables.values())).sparkSession
    order = spark.createDataFrame(listed, "position int, table string")
    digests = integrity.content_digests({n: tables[n] for _, n in listed})
    return order.join(digests, "table", "left").select(
        "table", "position", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"), F.coalesce("digest", F.lit("")).alias("digest"))


def export_snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str, height: int) -> dict:
    """Write a snapshot of the tables as of a height and return its marker; a folder that has one is refused.

    Digests are taken from the written parts, so tables that change meanwhile can't part from them.
    """
    prepare(spark)
    fs, mark = versions._path(spark, f"{path}/{MARKER}")
    if fs.exists(mark):
        raise FileExistsError(f"{path} holds a snapshot")
    chosen = ap.full_snapshot(tables)
    for _, name, df in chosen:
        df.write.mode("overwrite").parquet(f"{path}/{name}")  # what a dead writer left is no snapshot
    written = {name: spark.read.schema(df.schema).parquet(f"{path}/{name}") for _, name, df in chosen}
    found = {r.table: r for r in snapshot_manifest(written).collect()} if written else {}
    marker = {"height": height, "tables": [{"table": n, "position": p, "n_rows": found[n].n_rows, "digest": found[n].digest, "schema": df.schema.json()} for p, n, df in chosen]}
    out = fs.create(mark, False)
    try:
        out.write(bytearray(json.dumps(marker).encode()))
    finally:
        out.close()
    return marker


def load_snapshot(spark: SparkSession, path: str) -> tuple[int, dict[str, DataFrame]]:
    """(height, tables) of a published snapshot whose parts are what the marker says, else `DamagedSnapshot`."""
    prepare(spark)
    fs, mark = versions._path(spark, f"{path}/{MARKER}")
    if not fs.exists(mark):
        raise DamagedSnapshot(f"{path} was never published")
    stream = fs.open(mark)
    try:
        marker = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError as error:
        raise DamagedSnapshot(f"the marker of {path} is torn") from error
    finally:
        stream.close()
    tables = {}
    for t in marker["tables"]:
        fs, folder = versions._path(spark, f"{path}/{t['table']}")
        if not fs.exists(folder):
            raise DamagedSnapshot(f"table {t['table']} is missing")
        tables[t["table"]] = spark.read.schema(StructType.fromJson(json.loads(t["schema"]))).parquet(f"{path}/{t['table']}")
    if tables:
        try:
            found = {r.table: (r.n_rows, r.digest) for r in snapshot_manifest(tables).collect()}
        except Exception as error:  # Parquet refuses broken pages by itself
            raise DamagedSnapshot(f"parts of {path} can't be read") from error
        wrong = [t["table"] for t in marker["tables"] if found.get(t["table"]) != (t["n_rows"], t["digest"])]
        if wrong:
            raise DamagedSnapshot(f"tables {wrong} differ from their digests")
    return marker["height"], tables


def bootstrap(spark: SparkSession, root: str, path: str) -> int:
    """Replace a replica's tables by a checked snapshot and publish that as one version; local tables stay."""
    height, snapshot = load_snapshot(spark, path)
    head = versions.latest_version(spark, root)
    local = versions.read_tables(spark, root, head) if head is not None else {}
    after = ap.apply_full_snapshot(local, snapshot, height)
    gone = [t for t in local if t not in after]
    changed = {t: df for t, df in after.items() if df is not local.get(t)} | {t: local[t].limit(0) for t in gone}
    return versions.write_version(spark, root, changed, height, kind="bootstrap")


# ---- truncated bootstrap ---------------------------------------------------------------------------
def bootstrap_window(paged: dict[str, DataFrame], source: Callable[[], dict[str, DataFrame]], depth: int, delay: int | None, gas_tick: str,
                     statuses: DataFrame, rounds: int = 8) -> tuple[int, dict[str, DataFrame], dict[str, DataFrame], dict[str, DataFrame]]:
    """(base height, data, updated rows, lookups) of the last `depth` blocks, closed under lookup ids.

    `paged` are lookups read before the window; the source moves on meanwhile, so the window may point at ids that
    they lack.  Those are asked from the source again, and what the new rows point at, until nothing new turns up.
    An id the source lacks too is left open: any `*_id` value counts for every lookup.
    """
    tables = source()
    tip = tables["blocks"].agg(F.max("block_index")).first()[0]
    base = ap.truncated_base(tip if tip is not None else 0, depth)
    data, updated = ap.incremental_snapshot(tables, base, tip if tip is not None else 0, delay, gas_tick, statuses, skip_lookups=True)
    lookups, frontier = dict(paged), [*data.values(), *updated.values()]
    for _ in range(rounds):
        wanted = scan.referenced_ids(frontier) if any(c.endswith("_id") for df in frontier for c in df.columns) else None
        if wanted is None:
            break
        now = source()
        late = {n: now[n].join(wanted, "id", "left_semi").join(df.select("id"), "id", "left_anti") for n, df in lookups.items() if n in now}
        late = {n: df for n, df in late.items() if not df.isEmpty()}
        if not late:
            break
        lookups = {n: df.unionByName(late[n], allowMissingColumns=True) if n in late else df for n, df in lookups.items()}
        frontier = list(late.values())
    return base, data, updated, lookups


# ---- rows that expire in place ----------------------------------------------------------------------
def reconcile_diff(existing: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The source's rows and those it lost, each with what a replica has to do: insert, update, keep or delete."""
    rest = [c for c in source.columns if c not in keys]
    e = existing.select(*[F.col(k).alias(f"__e_{k}") for k in keys], F.struct(*[F.col(c) for c in rest], F.lit(1).alias("__1")).alias("__old"))
    s = source.select(*keys, F.struct(*rest, F.lit(1).alias("__1")).alias("__new"))
    same = [F.col(k).eqNullSafe(F.col(f"__e_{k}")) for k in keys]
    both = s.join(e, same, "full_outer")
    action = (F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete")
              .when(F.col("__old").eqNullSafe(F.col("__new")), "keep").otherwise("update"))
    here = F.col("__new").isNotNull()
    return both.select(action.alias("action"), *[F.when(here, F.col(k)).otherwise(F.col(f"__e_{k}")).alias(k) for k in keys],
                       *[F.coalesce("__new", "__old")[c].alias(c) for c in rest])


def reconcile(spark: SparkSession, root: str, table: str, source: DataFrame, keys: list[str], generation: int) -> int | None:
    """Bring a table to the source's rows by writing the difference only; None if nothing differs or the generation,
    which the version names, was reconciled before."""
    mark = f"reconcile:{table}"
    head = versions.latest_version(spark, root)
    for found in versions.chain(spark, root, head):
        name, _, number = (found["batch"] or "").rpartition("/")
        if name == mark and int(number) >= generation:
            return None
    diff = reconcile_diff(versions.read_table(spark, root, table, head), source, keys).where("action <> 'keep'")
    gone = diff.where("action <> 'insert'").select(*keys)
    if diff.isEmpty():
        return None
    staged = Staged(spark, root, {table: Delta(diff.where("action <> 'delete'").drop("action"), [(gone, keys)])})
    return staged.publish(versions.read_manifest(spark, root, head)["height"], "reconcile", f"{mark}/{generation}")


def last_generation(spark: SparkSession, root: str, table: str) -> int | None:
    """The newest generation of a table that was reconciled: the cadence survives a restart."""
    head = versions.latest_version(spark, root)
    for found in versions.chain(spark, root, head) if head is not None else ():
        name, _, number = (found["batch"] or "").rpartition("/")
        if name == f"reconcile:{table}":
            return int(number)
    return None
