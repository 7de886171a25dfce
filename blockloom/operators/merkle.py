"""Block-content Merkle trees: ordered leaves, roots, inclusion proofs.

Leaf positions come from a range partitioning by (block, order), so a block of any size is
ordered by many tasks.  Roots and proofs of blocks are folded where the sorted leaves lie: a task
gives the greatest whole subtrees of its part, and those few meet per block.  Leaves with given
positions are folded level by level, in groups of at most 2^10 neighbours.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from blockloom.functions import canon
from blockloom.operators import scan
from blockloom.operators.integrity import SHOWN, block_rows, canon_address, sort_columns
from blockloom.operators.ordered_hash import ORDER
from blockloom.session import ensure_checkpoint_dir, materialise, part_count, task_count

FAN_BITS = 10
ROUNDS = 4  # 2^40 leaves per block
LEDGER_KINDS = ("credit", "debit", "escrow")
ACTIONS = 3  # rank after those of the ledger kinds


LATE = ["x1", "x2"]  # what an action shows beside its sort key


def block_leaves(tables: dict[str, DataFrame], state_key_binary: bool | Column = True, late: bool = False) -> DataFrame:
    """(block_index, rank, order keys, leaf): all ledger leaves, then actions, then the contract arrays.

    With `late`, ledger rows and actions have no leaf yet and `LATE` beside their sort keys, which is less to shuffle than
    a hash; `sorted_leaves` and `block_positions` hash them where they lie sorted.
    """
    parts = []
    for (kind, i), df in block_rows(tables, state_key_binary).items():
        cols, shown = [F.col(c) for c in SHOWN[kind][i]], {}
        numbers, texts = sort_columns(df, kind, i)
        types = dict(df.dtypes)
        waits = late and kind != "contracts" and types["action_index"] in ("int", "bigint") and {types[c] for c in texts} <= {"string"}
        if kind == "ledger":
            cols[1] = canon_address("address")
            rank, leaf = i, canon.ledger_leaf(F.lit(LEDGER_KINDS[i]), *cols)
        elif kind == "actions":
            rank, leaf = ACTIONS, canon.action_leaf(*cols)
            shown = dict(zip(LATE, cols[1:])) if waits else {}
        else:
            name = ("contracts", "state", "executions", "emissions", "deposits", "withdrawals")[i]
            rank, leaf = 4 + i, canon.contract_leaf(name, *cols)
        keys = {f"n{j + 1}": F.col(c).cast("bigint") for j, c in enumerate(numbers)}
        keys.update({f"s{j + 1}": F.col(c).cast("string") for j, c in enumerate(texts)})
        order = [keys.get(k, F.lit(None).cast("bigint" if k[0] == "n" else "string")).alias(k) for k in ORDER]
        more = [shown.get(c, F.lit(None)).cast("string").alias(c) for c in LATE] if late else []
        parts.append(df.select(F.col("block_index").cast("bigint").alias("block_index"), F.lit(rank).alias("rank"), *order, *more,
                               (F.lit(None).cast("string") if waits else leaf).alias("leaf")))
    return reduce(DataFrame.unionByName, parts)


def _late_leaf(*ranks: int) -> Column:
    """The leaf as bytes, made from the sort keys and `LATE` where a row of these ranks has none yet."""
    made = {i: canon.ledger_leaf(F.lit(kind), F.col("n1"), scan.canonical_role(F.col("s1")), F.col("s2"), F.col("s3")) for i, kind in enumerate(LEDGER_KINDS)}
    made[ACTIONS] = canon.action_leaf(F.col("n1"), *map(F.col, LATE))
    return F.coalesce("leaf", *[F.when(F.col("rank") == r, F.unhex(made[r])) for r in ranks]).alias("leaf")


@dataclass(frozen=True)
class Sorted:
    """Rows range-partitioned and sorted by group and order, kept once, with what a task can't see of its neighbours."""
    rows: DataFrame  # the kept columns and __id, whose upper bits name the task
    group: list[str]
    base: dict[int, int]  # rows that the first group of a task has in earlier tasks
    cut: set[tuple]  # groups that lie in several tasks

    def over(self, walk, schema: str) -> DataFrame:
        """`walk` over each task's rows as frames with their positions in the group."""
        group, base = self.group, self.base
        return self.rows.mapInPandas(lambda batches: walk(_numbered(batches, group, base)), schema)


def _placed(keys: pd.DataFrame, current: tuple, at: int) -> tuple[np.ndarray, int]:
    """Positions of rows in their groups, where `current` is the group before them and has `at` rows; and how many rows
    at the front go on with it."""
    index, new = np.arange(len(keys)), np.zeros(len(keys), bool)
    for values in (keys[c].to_numpy() for c in keys):
        new[1:] |= values[1:] != values[:-1]
    new[0] = tuple(keys.iloc[0]) != current
    start = np.maximum.accumulate(np.where(new, index, -1))
    return np.where(start >= 0, index - start, index + at), int((start < 0).sum())


def _numbered(batches: Iterator[pd.DataFrame], group: list[str], base: dict[int, int]) -> Iterator[pd.DataFrame]:
    current, at = None, 0
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[group]
        if current is None:
            current, at = tuple(keys.iloc[0]), base.get(int(pdf["__id"].iloc[0]) >> 33, 0)
        position, _ = _placed(keys, current, at)
        current, at = tuple(keys.iloc[-1]), int(position[-1]) + 1
        yield pdf.drop(columns="__id").assign(__position=position)


def _in_order(df: DataFrame, group: list[str], order: list[str | Column], late: dict[str, Column]) -> DataFrame:
    """Rows range-partitioned and sorted by group and order; `late` columns are made after the shuffle.  Partitions grow
    with the input."""
    ranged = df.dropna(subset=group).repartitionByRange(part_count(df, 2), *group, *order)
    return ranged.withColumns(late).sortWithinPartitions(*group, *order)


def _bases(spans: DataFrame, group: list[str]) -> tuple[dict[int, int], set[tuple]]:
    """Rows that the first group of each task has in earlier ones, and the groups cut by task borders; `spans` are the
    groups of each __task with their __n rows."""
    one, key = F.struct(F.struct(*group).alias("g"), F.col("__n").alias("n")), F.struct(*group)
    ends = spans.groupBy("__task").agg(F.min_by(one, key).alias("a"), F.max_by(one, key).alias("z")).collect()  # a row per task
    base, cut, held, count = {}, set(), None, 0
    for r in sorted(ends, key=lambda r: r["__task"]):
        base[r["__task"]] = count if tuple(r.a.g) == held else 0
        if base[r["__task"]]:
            cut.add(held)
        count = base[r["__task"]] + r.a.n if r.a.g == r.z.g else r.z.n
        held = tuple(r.z.g)
    return base, cut


def sorted_once(df: DataFrame, group: list[str], order: list[str | Column], keep: list[str | Column], late: dict[str, Column] | None = None) -> Sorted:
    """Only the first group of a task can begin in an earlier one, so one row of counts per task places all rows."""
    rows = materialise(_in_order(df, group, order, late or {}).select(*keep, F.monotonically_increasing_id().alias("__id")))
    spans = rows.groupBy(*group, F.shiftright("__id", 33).alias("__task")).agg(F.count("*").alias("__n"))
    return Sorted(rows, group, *_bases(spans, group))


def _types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def with_positions(df: DataFrame, group: list[str], order: list[str | Column], out: str = "position", keep: list[str | Column] | None = None,
                   late: dict[str, Column] | None = None) -> DataFrame:
    """0-based position of each row inside its group; `keep` names the columns wanted beside it (default: all).

    A task numbers its rows as it writes them, compressed, to the checkpoint folder; rows of its first group then get the
    number of those in earlier tasks on top.  `late` columns are made after the shuffle.
    """
    keep, spark = list(df.columns if keep is None else keep), df.sparkSession
    ordered = _in_order(df, group, order, late or {})
    names = ordered.select(*keep).columns
    by = ordered.select(*[g for g in group if g not in names], *keep)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, current, at, front = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.select(group).to_pandas()
            if current is None:
                current = tuple(keys.iloc[0])
            position, same = _placed(keys, current, at)
            first = np.arange(len(keys)) < same if front else np.zeros(len(keys), bool)
            front = front and same == len(keys)
            current, at = tuple(keys.iloc[-1]), int(position[-1]) + 1
            more = [pa.array(np.full(len(keys), task, "int32")), pa.array(first), pa.array(position.astype("int64"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "__task", "__first", "__at"])

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/sorted-{uuid.uuid4().hex}"
    schema = f"{_types(by, by.columns)}, __task int, __first boolean, __at bigint"
    by.mapInArrow(number, schema).write.option("compression", "zstd").parquet(folder)
    rows = spark.read.schema(schema).parquet(folder)
    base, _ = _bases(rows.groupBy(*group, "__task").agg(F.count("*").alias("__n")), group)
    listed = ", ".join(f"{base.get(t, 0)}L" for t in range(max(base, default=0) + 1))
    before = F.when(F.col("__first"), F.get(F.expr(f"array({listed})"), F.col("__task"))).otherwise(0)
    return rows.select(*names, (F.col("__at") + before).alias(out))


def _fold(nodes: list[str], height: int, base: int) -> list[list[str]]:
    """Levels above `nodes` (a run of siblings at level `base`), padded with empty subtrees."""
    layer, levels = [bytes.fromhex(n) for n in nodes], []
    for up in range(height):
        if len(layer) % 2:
            layer.append(canon.EMPTY_ROOTS[base + up])
        layer = [canon.pair_digest(layer[i], layer[i + 1]) for i in range(0, len(layer), 2)]
        levels.append([n.hex() for n in layer])
    return levels


@pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _fold_levels(nodes: pd.Series, height: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([_fold(list(n), int(h), int(b)) for n, h, b in zip(nodes, height, base)])


def _tree_height(count: Column) -> Column:
    """Levels of a tree over `count` leaves padded to a power of two, without floating point."""
    return F.when(count <= 1, 0).otherwise(F.length(F.bin((count - 1).cast("bigint")))).cast("int")


def tree_nodes(leaves: DataFrame, group: list[str], all_levels: bool = True) -> DataFrame:
    """(group, level, position, hash, height): leaves are level 0, the root sits at level `height`.

    With `all_levels=False` only each round's topmost nodes are kept, enough for roots.
    """
    counts = leaves.groupBy(*group).agg(F.count("*").alias("__n")).select(*group, _tree_height(F.col("__n")).alias("height"))
    current = leaves.join(counts, group).select(*group, "height", F.col("position").cast("bigint").alias("position"), F.col("leaf").alias("hash"))
    kept = [current.withColumn("level", F.lit(0))]
    for r in range(ROUNDS):
        base = r * FAN_BITS
        todo = current if r == 0 else current.where(F.col("height") > base)
        tasks = task_count(leaves.sparkSession)
        placed = todo.withColumn("__g", F.shiftright("position", FAN_BITS)).repartition(tasks, *group, "__g")
        grouped = placed.groupBy(*group, "height", "__g").agg(
            F.array_sort(F.collect_list(F.struct("position", "hash"))).alias("__s"))
        steps = F.greatest(F.lit(0), F.least(F.lit(FAN_BITS), F.col("height") - base))
        folded = grouped.withColumn("__levels", _fold_levels(F.col("__s.hash"), steps, F.lit(base)))
        opened = folded.select(*group, "height", "__g", F.posexplode("__levels").alias("__up", "__nodes"))
        spread = opened.select(*group, "height", "__g", (F.col("__up") + base + 1).alias("level"), F.posexplode("__nodes").alias("__i", "hash"))
        nodes = spread.withColumn("position", F.expr(
            f"shiftleft(__g, cast({FAN_BITS + base} - level as int)) + __i")).drop("__g", "__i")
        if all_levels:
            kept.append(nodes)
        else:
            kept.append(nodes.where(F.col("level") == F.least(F.col("height"), F.lit(base + FAN_BITS))))
        current = nodes.where(F.col("level") == base + FAN_BITS).drop("level")
    return reduce(DataFrame.unionByName, [k.select(*group, "height", "level", "position", "hash") for k in kept])


def merkle_roots(leaves: DataFrame, group: list[str]) -> DataFrame:
    """(group, root, leaf_count) over leaves with positions."""
    nodes = tree_nodes(leaves, group, all_levels=False)
    top = nodes.where("level = height").select(*group, F.col("hash").alias("root"))
    counted = leaves.groupBy(*group).agg(F.count("*").alias("leaf_count")).join(top, group, "left")
    too_many = F.raise_error(F.lit(f"a group has more than 2^{FAN_BITS * ROUNDS} leaves"))
    return counted.select(*group, F.coalesce("root", too_many.cast("string")).alias("root"), "leaf_count")


def _push(stack: list[tuple[int, int, bytes]], level: int, at: int, node: bytes) -> None:
    """Append a node to the greatest whole subtrees of a run; two halves become one."""
    while stack and at & 1 and stack[-1][0] == level and stack[-1][1] == at - 1:
        node = canon.pair_digest(stack.pop()[2], node)
        level, at = level + 1, at >> 1
    stack.append((level, at, node))


def _runs(frames: Iterator[pd.DataFrame], group: list[str]) -> Iterator[tuple[tuple, int, list[bytes], bool]]:
    """(group, first position, leaves, whether the group ends here) piece by piece."""
    held = None
    for pdf in frames:
        leaves, places = pdf["leaf"].tolist(), pdf["__position"].to_numpy()
        keys = pdf[group]
        new = (keys != keys.shift()).any(axis=1).to_numpy().copy()
        new[0] = True
        marks = [*np.flatnonzero(new).tolist(), len(pdf)]
        for a, b in zip(marks, marks[1:]):
            key = tuple(keys.iloc[a])
            if held is not None and held != key:
                yield held, 0, [], True
            held = key
            yield key, int(places[a]), leaves[a:b], False
    if held is not None:
        yield held, 0, [], True


def run_nodes(kept: Sorted, only: set[tuple] | None = None) -> DataFrame:
    """(group, level, position, hash, n): the greatest whole subtrees of each group in each task, at most two a level;
    `n` counts the leaves below.  No row leaves its task."""
    group = kept.group

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack, out = [], []
        for key, at, leaves, last in _runs(frames, group):
            if only is not None and key not in only:
                continue
            for i, leaf in enumerate(leaves):
                _push(stack, 0, at + i, leaf)
            if last:
                out += [(*key, level, p, node, 1 << level) for level, p, node in stack]
                stack = []
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=[*group, "level", "position", "hash", "n"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=[*group, "level", "position", "hash", "n"])

    return kept.over(walk, f"{_types(kept.rows, group)}, level int, position bigint, hash binary, n bigint")


class _Known:
    """Nodes of one tree over `count` leaves, from whole subtrees that cover them; the rest is folded when asked."""

    def __init__(self, count: int):
        self.count, self.height, self.nodes = count, (count - 1).bit_length(), {}

    def add(self, level: int, at: int, node: bytes) -> None:
        self.nodes[level, at] = node

    def add_run(self, first: int, leaves: list[bytes]) -> None:
        """All nodes that lie within a run of leaves."""
        level = 0
        while leaves:
            self.nodes.update(((level, first + i), node) for i, node in enumerate(leaves))
            skip = first & 1
            leaves = [canon.pair_digest(leaves[i], leaves[i + 1]) for i in range(skip, len(leaves) - 1, 2)]
            first, level = (first + skip) >> 1, level + 1

    def node(self, level: int, at: int) -> bytes:
        found = self.nodes.get((level, at))
        if found is None:
            found = canon.EMPTY_ROOTS[level] if at << level >= self.count else canon.pair_digest(
                self.node(level - 1, 2 * at), self.node(level - 1, 2 * at + 1))
            self.nodes[level, at] = found
        return found

    def root(self) -> bytes:
        return self.node(self.height, 0)


@pandas_udf(T.StringType())
def _root_of(count: pd.Series, levels: pd.Series, positions: pd.Series, hashes: pd.Series) -> pd.Series:
    out = []
    for n, *nodes in zip(count, levels, positions, hashes):
        tree = _Known(int(n))
        for level, at, node in zip(*nodes):
            tree.add(int(level), int(at), bytes(node))
        out.append(tree.root().hex())
    return pd.Series(out, dtype=object)


IN_BLOCK = ["rank", *ORDER, "leaf"]


def _to_sort(leaves: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Leaves as bytes, and the columns made after the shuffle: leaves of actions, which may decide between equal keys
    (equal keys of ledger rows are equal leaves)."""
    return leaves.withColumn("leaf", F.unhex("leaf")), {"leaf": _late_leaf(ACTIONS)} if "x1" in leaves.columns else {}


def sorted_leaves(leaves: DataFrame) -> Sorted:
    """Block leaves in their order, kept as block and 32 bytes each."""
    raw, late = _to_sort(leaves)
    return sorted_once(raw, ["block_index"], IN_BLOCK, ["block_index", _late_leaf(*range(ACTIONS)) if late else F.col("leaf")], late)


def block_positions(leaves: DataFrame) -> DataFrame:
    """(block_index, leaf, position) of block leaves; late ones are kept as what they are made from."""
    raw, late = _to_sort(leaves)
    if not late:
        placed = with_positions(raw, ["block_index"], IN_BLOCK, keep=["block_index", "leaf"])
    else:
        given = F.when(F.col("rank") > ACTIONS, F.col("leaf")).alias("leaf")
        placed = with_positions(raw, ["block_index"], IN_BLOCK, keep=["block_index", "rank", "n1", "s1", "s2", "s3", *LATE, given], late=late)
        placed = placed.withColumn("leaf", _late_leaf(*range(ACTIONS + 1)))
    return placed.select("block_index", F.lower(F.hex("leaf")).alias("leaf"), "position")


def block_merkle_roots(tables: dict[str, DataFrame], blocks: DataFrame, state_key_binary: bool | Column = True) -> DataFrame:
    """Content root per block; a block with no rows has the empty-leaf root."""
    rows = block_leaves(tables, state_key_binary, late=True).join(blocks.select("block_index"), "block_index", "left_semi")
    nodes = run_nodes(sorted_leaves(rows)).groupBy("block_index").agg(
        F.sum("n").alias("leaf_count"), F.collect_list(F.struct("level", "position", "hash")).alias("__s"))
    found = nodes.select("block_index", "leaf_count", _root_of("leaf_count", "__s.level", "__s.position", "__s.hash").alias("root"))
    return blocks.select("block_index").join(found, "block_index", "left").select(
        "block_index", F.coalesce("root", F.lit(canon.EMPTY_ROOTS[0].hex())).alias("block_merkle_root"),
        F.coalesce("leaf_count", F.lit(0)).cast("bigint").alias("leaf_count"))


def block_inclusion_proofs(leaves: DataFrame, siblings: bool = True) -> DataFrame:
    """(block_index, position, leaf, siblings bottom-up, root, verified) of every block leaf, each proof folded again from
    its leaf.  A task makes the proofs of the leaves it holds; of a block in several tasks it is told the others' greatest
    subtrees, so no path is shuffled.  Without `siblings` that column stays out."""
    kept = sorted_leaves(leaves)
    others: dict[int, list] = {}
    for r in run_nodes(kept, kept.cut).collect() if kept.cut else ():  # at most two blocks a task, two nodes a level
        others.setdefault(r.block_index, []).append((r.level, r.position, bytes(r.hash), r.n))
    columns = ["block_index", "position", "leaf", *(["siblings"] if siblings else []), "root", "verified"]

    def proofs(block: int, first: int, held: list[bytes]) -> Iterator[pd.DataFrame]:
        far = others.get(block, ())
        tree = _Known(sum(n for *_, n in far) or len(held))
        for level, at, node, _ in far:
            tree.add(level, at, node)
        tree.add_run(first, held)
        root, pair, out = tree.root(), canon.pair_digest, []
        for at, leaf in enumerate(held, first):
            path = [tree.node(k, at >> k ^ 1) for k in range(tree.height)]
            node, i = leaf, at
            for sibling in path:
                node = pair(sibling, node) if i & 1 else pair(node, sibling)
                i >>= 1
            out.append((block, at, leaf.hex(), *([[p.hex() for p in path]] if siblings else []), root.hex(), node == root))
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, first = [], 0
        for (block,), at, piece, last in _runs(frames, ["block_index"]):
            if last:
                yield from proofs(int(block), first, held)
                held = []
                continue
            first = first if held else at
            held += piece

    shown = "siblings array<string>, " if siblings else ""
    return kept.over(walk, f"block_index bigint, position bigint, leaf string, {shown}root string, verified boolean")


def inclusion_proofs(leaves: DataFrame, group: list[str]) -> DataFrame:
    """(group, position, leaf, siblings bottom-up, root) for every placed leaf."""
    nodes = tree_nodes(leaves, group)
    heights = nodes.where("level = height").select(*group, "height", F.col("hash").alias("root"))
    steps = leaves.join(heights, group).withColumn(
        "__level", F.explode_outer(F.when(F.col("height") > 0, F.sequence(F.lit(0), F.col("height") - 1))))
    wanted = steps.withColumn("__at", F.expr("shiftright(cast(position as bigint), __level) ^ 1"))
    siblings = nodes.select(*group, F.col("level").alias("__level"), F.col("position").alias("__at"), F.col("hash").alias("__h"))
    empty = F.array(*[F.lit(e.hex()) for e in canon.EMPTY_ROOTS[:FAN_BITS * ROUNDS]])
    found = wanted.join(siblings, [*group, "__level", "__at"], "left").withColumn(
        "__h", F.coalesce("__h", F.get(empty, F.col("__level"))))
    path = F.transform(F.array_sort(F.collect_list(F.when(F.col("__level").isNotNull(), F.struct("__level", "__h")))), lambda s: s["__h"])
    return found.groupBy(*group, "position", "leaf", "root").agg(path.alias("siblings"))


def verify_inclusion(proofs: DataFrame) -> DataFrame:
    return proofs.withColumn("verified", canon.fold_proof(F.col("leaf"), F.col("position"), F.col("siblings")) == F.col("root"))
