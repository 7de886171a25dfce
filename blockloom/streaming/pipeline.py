"""Applying change batches to versioned tables: apply, verify, publish, follow reorganisations, stop on a halt.

One micro-batch is one atomic step: its parts are written, verified as they landed, and become visible with
the manifest, which also names the micro-batch; so a batch that comes again after a crash is recognised,
whether or not its version was published.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blockloom.fixed_values import BLOCKS_PER_POLL, MAX_ROLLBACK_DEPTH
from blockloom.operators import follow, rollback, scan
from blockloom.operators.verify import mismatches
from blockloom.operators.apply import HEIGHT, batch_changes
from blockloom.session import prepare
from blockloom.sources.versions import Staged, branch, chain, compact, latest_version, read_manifest, read_tables, write_version

VERDICTS = "at timestamp, kind string, block_index bigint, detail string"
PAYLOAD = "block_index bigint, table string, channel string, row_json string"
HASHES = ("ledger_hash", "actions_hash", "contract_hash")
Fetch = Callable[[int, int], DataFrame]


class Halted(RuntimeError):
    """An uncleared halt forbids further applies."""


class NeedsCatchUp(RuntimeError):
    """The batch does not follow the committed tip: a gap before or in it, or another block at a known height."""


def verdicts(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(VERDICTS).parquet(f"{root}/verdicts")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], VERDICTS)
        raise


def record_verdict(spark: SparkSession, root: str, kind: str, block_index: int | None, detail: str) -> None:
    """A durable verdict; of halts and clears the newest decides, other kinds are a record."""
    row = spark.createDataFrame([(kind, block_index, detail)], "kind string, block_index bigint, detail string")
    row.select(F.current_timestamp().alias("at"), "kind", "block_index", "detail").coalesce(1).write.mode("append").parquet(f"{root}/verdicts")


def active_halt(spark: SparkSession, root: str) -> str | None:
    deciding = verdicts(spark, root).where(F.col("kind").isin("halt", "clear"))
    last = deciding.agg(F.max_by(F.struct("kind", "detail"), "at").alias("v")).first().v
    return last.detail if last is not None and last.kind == "halt" else None


def load_tables(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    version = latest_version(spark, root) if version is None else version
    return {} if version is None else read_tables(spark, root, version)


def decode_payload(batch: DataFrame, schemas: dict[str, object], channel: str) -> dict[str, DataFrame]:
    """Change rows (table, channel, row_json) back to one frame per known table.

    Tables absent from the batch come out empty, which applies as nothing.
    """
    from blockloom.functions.canon import decode_binary_json

    rows = batch.where(F.col("channel") == channel)
    height = [F.col("block_index").alias(HEIGHT)] if "block_index" in batch.columns else []
    return {t: decode_binary_json(rows.where(F.col("table") == t), s, also=height) for t, s in schemas.items()}


# ---- what follows what ---------------------------------------------------------------------------
def first_fork(batch: DataFrame, blocks: DataFrame) -> int | None:
    """Lowest height at which the batch shows a block with other hashes than the committed one."""
    fields = [c for c in (*HASHES, "block_hash") if c in blocks.columns]
    if not fields:
        return None
    shown = decode_payload(batch.where(F.col("table") == "blocks"), {"blocks": blocks.schema}, "data")["blocks"]
    known = blocks.select("block_index", *[F.col(c).alias(f"__{c}") for c in fields])
    differs = [~F.col(c).eqNullSafe(F.col(f"__{c}")) & F.col(c).isNotNull() for c in fields]
    return shown.join(known, "block_index").where(reduce(or_, differs)).agg(F.min("block_index")).first()[0]


def missing_range(batch: DataFrame, tip: int | None) -> tuple[int, int] | None:
    """First and last height that the batch lacks between the committed tip and its own highest block."""
    new = batch.where(F.col("block_index") > tip) if tip is not None else batch
    low, high, n = new.agg(F.min("block_index"), F.max("block_index"), F.countDistinct("block_index")).first()
    if low is None or ((tip is None or low == tip + 1) and n == high - low + 1):
        return None
    return (tip + 1 if tip is not None else low), high


def tip_of(blocks: DataFrame) -> int | None:
    return blocks.agg(F.max("block_index")).first()[0]


def check_continuity(spark: SparkSession, root: str, batch: DataFrame, blocks: DataFrame) -> None:
    """Record a verdict and raise where a batch shows another block at a known height, or leaves a gap.

    A block of a known height must carry the committed hashes; new heights must follow the tip one by one.
    """
    fork = first_fork(batch, blocks)
    if fork is not None:
        record_verdict(spark, root, "fork", fork, f"block {fork} differs from the committed one")
        raise NeedsCatchUp(f"fork at {fork}")
    tip = tip_of(blocks)
    gap = missing_range(batch, tip)
    if gap is not None:
        record_verdict(spark, root, "gap", gap[0], f"tip {tip}, batch up to {gap[1]}")
        raise NeedsCatchUp(f"gap after {tip}")


# ---- reorganisation -------------------------------------------------------------------------------
def roll_back(spark: SparkSession, root: str, height: int, **how) -> int:
    """Publish the tables as they were just below a height, as a branch of the version chain; returns the version.

    Where a version ends right below the height, the branch starts there and nothing is written but a
    manifest.  Where the height lies inside a version, that version's tables are rolled back and written; `how`
    goes to `rollback.rollback_indexer`.
    """
    head = latest_version(spark, root)
    discarded: list[int] = []
    above: int | None = None
    for found in chain(spark, root, head):
        if found["height"] < height:
            if found["height"] == height - 1 or above is None:
                return branch(spark, root, found["version"]) if above is not None else head
            break
        above = found["version"]
        discarded.append(above)
    if above is None:
        raise ValueError(f"nothing to roll back to below {height}")
    tables = load_tables(spark, root, above)
    rolled = rollback.rollback_indexer(tables, height, **how)
    changed = {t: df for t, df in rolled.items() if df is not tables.get(t)}
    return write_version(spark, root, changed, height - 1, kind="rollback", parent=above, discards=discarded[:-1])


def follow_reorg(spark: SparkSession, root: str, fork: int, tip: int, max_depth: int = MAX_ROLLBACK_DEPTH, **how) -> int:
    """Roll back to a fork, or record a halt where that is too deep; the verdict is recorded either way."""
    event = spark.createDataFrame([(fork,)], "block_index bigint")
    verdict = follow.reorg_verdicts(event, tip, max_depth).first().verdict
    if verdict != "rollback":
        detail = f"reorg at {fork} below tip {tip}: {verdict}"
        record_verdict(spark, root, "halt", fork, detail)
        raise Halted(detail)
    version = roll_back(spark, root, fork, **how)
    gone = read_manifest(spark, root, version)["discards"]
    record_verdict(spark, root, "reorg", fork, f"tip {tip} rolled back to {fork - 1}; versions {gone} discarded")
    return version


# ---- apply ----------------------------------------------------------------------------------------
def already_published(spark: SparkSession, root: str, batch_key: str) -> bool:
    """Whether a version on the head's chain came from this micro-batch.  Only a stream's last batch can come
    again, so the search ends at the last version of the same stream."""
    stream = batch_key.rpartition("/")[0]
    head = latest_version(spark, root)
    for found in chain(spark, root, head) if head is not None else ():
        if (found["batch"] or "").rpartition("/")[0] == stream:
            return found["batch"] == batch_key
    return False


def apply_batch(spark: SparkSession, root: str, batch: DataFrame, bucket_width: int | None = None,
                verify: bool = True, schema_version: int | None = None, fetch: Fetch | None = None, reorg: bool = False,
                batch_key: str | None = None, commitments: dict | None = None, **how) -> int | None:
    """Apply one payload batch on the newest version and publish the next; returns its number.

    `batch`: block_index, table, channel, row_json, and schema_version when that is checked.
    Heights already applied are skipped, so replaying a batch is harmless.  A different block at such a
    height is recorded and raises `NeedsCatchUp`, or, with `reorg`, rolls back to it and goes on with the new
    blocks.  Heights that lack between the tip and the batch are asked from `fetch(low, high)`; without it, or
    where it lacks them too, that raises `NeedsCatchUp`.  With `verify` the new heights' hashes, and with
    `commitments` (chain, network, delay) also their roots and state hash, are recomputed from the landed rows
    before anything is published; a difference is recorded as a halt.  What is written grows with the batch, not
    with the tables.
    """
    prepare(spark)
    reason = active_halt(spark, root)
    if reason is not None:
        raise Halted(reason)
    if batch_key is not None and already_published(spark, root, batch_key):
        return None
    tables = load_tables(spark, root)
    if schema_version is not None:
        batch = scan.schema_gate(batch, schema_version)
    if reorg:
        fork = first_fork(batch, tables["blocks"])
        if fork is not None:
            follow_reorg(spark, root, fork, tip_of(tables["blocks"]), **how)
            tables = load_tables(spark, root)
    gap = missing_range(batch, tip_of(tables["blocks"])) if fetch is not None else None
    if gap is not None:
        columns = ["block_index", "table", "channel", "row_json"]
        shown = batch.select("block_index").distinct()
        batch = batch.select(*columns).unionByName(fetch(*gap).select(*columns).join(shown, "block_index", "left_anti"))
    check_continuity(spark, root, batch, tables["blocks"])
    fresh = scan.skip_applied(batch, tables["blocks"])
    low, high = fresh.agg(F.min("block_index"), F.max("block_index")).first()
    if low is None:
        return None
    staged = stage(spark, root, tables, fresh, (low, high))
    if verify:
        check_landed(spark, root, tables, staged.tables(), low, high, **(commitments or {}))
    return staged.publish(high, batch=batch_key)


def stage(spark: SparkSession, root: str, tables: dict[str, DataFrame], rows: DataFrame, window: tuple[int, int]) -> Staged:
    """Payload rows of a window of heights, written as parts of the next version; unchecked and not yet published."""
    schemas = {t: df.schema for t, df in tables.items()}
    present = {(r.table, r.channel) for r in rows.select("table", "channel").distinct().collect()}  # bounded by the table list
    data = {t: df for t, df in decode_payload(rows, schemas, "data").items() if (t, "data") in present}
    updated = {t: df for t, df in decode_payload(rows, schemas, "updated").items() if (t, "updated") in present}
    return Staged(spark, root, batch_changes(tables, data, updated, window, tables.get("index_statuses")))


def check_landed(spark: SparkSession, root: str, before: dict[str, DataFrame], landed: dict[str, DataFrame], low: int, high: int, **commitments) -> None:
    """Recompute the commitments of the heights low..high from landed rows; the lowest difference is recorded as a halt."""
    bad = mismatches(before, landed, low, high, **commitments).orderBy("block_index", "field").first()
    if bad is not None:
        detail = f"{bad.field} of block {bad.block_index} does not match its rows"
        record_verdict(spark, root, "halt", bad.block_index, detail)
        raise Halted(detail)


def run_pipeline(payloads: DataFrame, root: str, checkpoint: str, bucket_width: int | None = None,
                 on_version: Callable[[int], None] | None = None, fetch: Fetch | None = None, reorg: bool = False,
                 compact_every: int | None = None, **how) -> StreamingQuery:
    """Follow a payload stream; batches are serial, so catch-up always starts at the committed tip + 1.

    With `reorg` and `fetch` the stream goes on through forks and gaps.  Tables of more than `compact_every`
    added parts are rewritten whole after a batch.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = batch.persist()
        try:
            key = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}/{number}"
            version = apply_batch(spark, root, kept, fetch=fetch, reorg=reorg, batch_key=key, **how)
        finally:
            kept.unpersist()
        if version is not None and compact_every is not None:
            compact(spark, root, bucket_width, compact_every)
        if version is not None and on_version is not None:
            on_version(version)

    return payloads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def payload_source(spark: SparkSession, path: str, files_per_batch: int = BLOCKS_PER_POLL) -> DataFrame:
    """Payload files as a stream, a bounded number per micro-batch."""
    return spark.readStream.schema(PAYLOAD).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(path)


def range_source(spark: SparkSession, path: str) -> Fetch:
    """A bounded source of payload rows by height, to catch up from.  Each write has a folder of its own; of a height
    written several times, as after a reorganisation, the newest folder counts."""

    def fetch(low: int, high: int) -> DataFrame:
        rows = spark.read.schema(PAYLOAD).option("recursiveFileLookup", "true").parquet(path).where(F.col("block_index").between(low, high))
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
        stamped = rows.select("*", folder.alias("__folder"), F.col("_metadata.file_modification_time").alias("__at"))
        newest = stamped.groupBy("block_index").agg(F.max_by("__folder", F.struct("__at", "__folder")).alias("__folder"))
        return stamped.drop("__at").join(newest, ["block_index", "__folder"], "left_semi").drop("__folder")

    return fetch
