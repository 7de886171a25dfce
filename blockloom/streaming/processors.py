"""Stateful stream operators: following a chain, guarding against forks, cross-source agreement, strikes.

Each is a `StatefulProcessor` over header-sized rows (height and hash, never block contents), so
a key's state and micro-batch stay small.  They need the RocksDB state store (`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from blockloom.fixed_values import (
    HASH_CONFIRM_TIMEOUT_MS,
    MAX_ROLLBACK_DEPTH,
    RECENT_HASH_CAP,
    STRIKE_THRESHOLD,
    STRIKE_WINDOW,
)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> list[dict]:
    pdf = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
    return [{k: None if pd.isna(v) else v for k, v in r.items()} for r in pdf.to_dict("records")]


def _frame(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in columns if c in ("block_index", "from_block", "to_block", "source", "n_strikes", "n_agreeing")})


FOLLOW_OUT = "chain string, kind string, block_index bigint, verdict string, from_block bigint, to_block bigint"


class Follow(StatefulProcessor):
    """Per chain: which block events extend the tip, repeat it, fork it, leave a gap, or must roll back.

    Input columns: chain, seq, kind (block / status / reorg / clear), block_index, hash.
    """

    columns = ["chain", "kind", "block_index", "verdict", "from_block", "to_block"]

    def __init__(self, max_depth: int = MAX_ROLLBACK_DEPTH):
        self.max_depth = max_depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tip = handle.getValueState("tip", "height bigint, hash string, halted boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        height, known, halted = self.tip.get() if self.tip.exists() else (None, None, False)
        out = []
        for r in _rows(rows, ["seq"]):
            kind, at, seen = r["kind"], r["block_index"], r.get("hash")
            at = None if at is None else int(at)
            span = (None, None)
            if kind == "clear":
                halted, verdict = False, "halt cleared"
            elif halted:
                verdict = "halted"
            elif kind == "reorg":
                if height is None:
                    verdict = "ignored: empty replica"
                elif at > height:
                    verdict = "ignored: above tip"
                elif height - at + 1 > self.max_depth:
                    verdict, halted = "halt: too deep", True
                else:
                    verdict, span, height, known = "rollback", (at, height), at - 1, None
            elif kind == "status":
                if height is not None and at is not None and at > height + 1:
                    verdict, span, height, known = "catch up", (height + 1, at), at, None
                else:
                    verdict = "in step"
            elif height is None and at > 0:
                verdict, span, height, known = "catch up", (0, at), at, seen
            elif height is not None and at <= height:
                fork = at == height and known is not None and seen is not None and seen != known
                verdict = "fork at head" if fork else "duplicate"
                span = (height + 1, at) if fork else span
            elif height is not None and at > height + 1:
                verdict, span, height, known = "catch up", (height + 1, at), at, seen
            else:
                verdict, height, known = "apply", at, seen
            out.append((key[0], kind, at, verdict, *span))
        self.tip.update((height, known, halted))
        yield from _frame(out, self.columns)

    def close(self) -> None:
        pass


GUARD_OUT = "chain string, verdict string, block_index bigint"


class ForkGuard(StatefulProcessor):
    """Per chain: remembers the hash of the last heights sent and reports where the source's content
    changed below its cursor, or where its tip fell.

    Input columns: chain, seq (poll number), block_index, hash: what the source shows at each poll.
    """

    columns = ["chain", "verdict", "block_index"]

    def __init__(self, cap: int = RECENT_HASH_CAP):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "height bigint")
        self.recent = handle.getMapState("recent", "height bigint", "hash string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Start from what the log recorded as sent, not from what the source shows now: a reorganisation that ended
        while the guard was down is found at the first poll."""
        cursor = self.cursor.get()[0] if self.cursor.exists() else -1
        for at, known in zip(initialState["block_index"], initialState["hash"]):
            cursor = max(cursor, int(at))
            if not pd.isna(known):
                self.recent.updateValue((int(at),), (known,))
        self.cursor.update((cursor,))

    def _hash_at(self, height: int) -> str | None:
        return self.recent.getValue((height,))[0] if self.recent.containsKey((height,)) else None

    def _fork(self, start: int, shown: dict[int, str]) -> int:
        """One above the highest earlier height that doesn't differ: agreed, unrecorded, not shown, or below 1."""
        heights = range(max(0, start - self.cap - 1), start)
        recorded = {h: self._hash_at(h) for h in heights}
        return 1 + max((h for h in heights if h < 1 or recorded[h] is None or shown.get(h) in (None, recorded[h])), default=start - 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        polls: dict[int, dict[int, str]] = {}
        for r in _rows(rows, ["seq", "block_index"]):
            polls.setdefault(int(r["seq"]), {})[int(r["block_index"])] = r["hash"]
        out, cursor = [], self.cursor.get()[0] if self.cursor.exists() else None
        for _, shown in sorted(polls.items()):
            top, fork = max(shown), None
            if cursor is not None:
                known, now = self._hash_at(cursor), shown.get(cursor)
                if known is not None and now is not None and now != known:
                    fork = self._fork(cursor, shown)
                elif top < cursor:
                    fork = self._fork(top + 1, shown)
            if fork is not None:
                out.append((key[0], "reorg", fork))
                for (h,) in list(self.recent.keys()):
                    if h >= fork:
                        self.recent.removeKey((h,))
                cursor = fork - 1
            for h in sorted(h for h in shown if cursor is None or h > cursor):
                out.append((key[0], "send", h))
                self.recent.updateValue((h,), (shown[h],))
                cursor = h
            for (h,) in list(self.recent.keys()):
                if h <= cursor - self.cap:
                    self.recent.removeKey((h,))
        if cursor is not None:
            self.cursor.update((cursor,))
        yield from _frame(out, self.columns)

    def close(self) -> None:
        pass


AGREE_OUT = "block_index bigint, verdict string, hash string, n_agreeing bigint, dissenters string"


class Agreement(StatefulProcessor):
    """Per height: collects what each source reports and decides once.

    Applies at quorum, halts when every source spoke without one; a timer settles the rest: apply
    from the first reporter, or hold for good when strict.  Input columns: block_index, source,
    seq, hash.
    """

    columns = ["block_index", "verdict", "hash", "n_agreeing", "dissenters"]

    def __init__(self, n_sources: int, quorum: int | None = None, strict: bool = False, timeout_ms: int = HASH_CONFIRM_TIMEOUT_MS):
        self.n_sources, self.strict, self.timeout_ms = n_sources, strict, timeout_ms
        self.quorum = min(n_sources // 2 + 1 if quorum is None else quorum, max(1, n_sources))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reports = handle.getMapState("reports", "source bigint", "hash string")
        self.first = handle.getValueState("first", "hash string")
        self.decided = handle.getValueState("decided", "verdict string")

    def _settle(self, key, verdict: str, chosen: str | None, reports: dict[int, str]) -> tuple:
        self.decided.update((verdict,))
        agreeing = sum(1 for h in reports.values() if h == chosen)
        against = ",".join(str(s) for s, h in sorted(reports.items()) if verdict == "apply" and h != chosen)
        if verdict != "hold":  # nothing more is decided for this height
            self.reports.clear()
            self.first.clear()
        return (int(key[0]), verdict, chosen, agreeing, against)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        incoming = _rows(rows, ["seq"])
        if self.decided.exists() and self.decided.get()[0] != "hold":
            return
        for r in incoming:
            self.reports.updateValue((int(r["source"]),), (r["hash"],))
            if not self.first.exists():
                self.first.update((r["hash"],))
        reports = {int(k[0]): v[0] for k, v in self.reports.iterator()}
        votes: dict[str, int] = {}
        for h in reports.values():
            votes[h] = votes.get(h, 0) + 1
        best = max(votes, key=lambda h: (votes[h], h))
        out = []
        if votes[best] >= self.quorum:
            out.append(self._settle(key, "apply", best, reports))
        elif len(reports) >= self.n_sources:
            out.append(self._settle(key, "halt", None, reports))
        elif not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield from _frame(out, self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.decided.exists():
            return
        reports = {int(k[0]): v[0] for k, v in self.reports.iterator()}
        verdict, chosen = ("hold", None) if self.strict else ("apply primary", self.first.get()[0])
        yield from _frame([self._settle(key, verdict, chosen, reports)], self.columns)

    def close(self) -> None:
        pass


STRIKE_OUT = "source bigint, block_index bigint, n_strikes bigint, over_threshold boolean"


class Strikes(StatefulProcessor):
    """Per source: dissents inside a sliding window of heights.  Input: source, block_index (one row per dissent)."""

    columns = ["source", "block_index", "n_strikes", "over_threshold"]

    def __init__(self, window: int = STRIKE_WINDOW, threshold: int = STRIKE_THRESHOLD):
        self.window, self.threshold = window, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heights = handle.getMapState("heights", "height bigint", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        held = {int(k[0]) for k in self.heights.keys()}
        for r in _rows(rows, ["block_index"]):
            at = int(r["block_index"])
            held = {h for h in held | {at} if h > at - self.window}
            out.append((int(key[0]), at, len([h for h in held if h <= at]), len([h for h in held if h <= at]) >= self.threshold))
        for k in list(self.heights.keys()):
            if int(k[0]) not in held:
                self.heights.removeKey(k)
        for h in held:
            self.heights.updateValue((h,), (True,))
        yield from _frame(out, self.columns)

    def close(self) -> None:
        pass


def follow(events: DataFrame, max_depth: int = MAX_ROLLBACK_DEPTH) -> DataFrame:
    return events.groupBy("chain").transformWithStateInPandas(Follow(max_depth), FOLLOW_OUT, "Append", "None")


def guard_forks(observed: DataFrame, recorded: DataFrame | None = None, cap: int = RECENT_HASH_CAP) -> DataFrame:
    """`recorded` (chain, block_index, hash): heights that the log says were sent, to start from where the stream has no
    state yet; the last `cap` of each chain are used."""
    seed = None
    if recorded is not None:
        tip = recorded.groupBy("chain").agg(F.max("block_index").alias("__tip"))
        seed = recorded.join(tip, "chain").where(F.col("block_index") > F.col("__tip") - cap).select("chain", "block_index", "hash").groupBy("chain")
    return observed.groupBy("chain").transformWithStateInPandas(ForkGuard(cap), GUARD_OUT, "Append", "None", initialState=seed)


def agree(reports: DataFrame, n_sources: int, quorum: int | None = None, strict: bool = False,
          timeout_ms: int = HASH_CONFIRM_TIMEOUT_MS) -> DataFrame:
    return reports.groupBy("block_index").transformWithStateInPandas(
        Agreement(n_sources, quorum, strict, timeout_ms), AGREE_OUT, "Append", "ProcessingTime")


def strike(dissents: DataFrame) -> DataFrame:
    return dissents.groupBy("source").transformWithStateInPandas(Strikes(), STRIKE_OUT, "Append", "None")
