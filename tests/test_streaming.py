"""Stream operators against their expected event sequences and their batch twins."""

import time

import pytest
from pyspark.sql import functions as F

from blockloom.operators import follow as batch
from blockloom.streaming import processors as st


@pytest.fixture()
def run(spark, tmp_path):
    st.use_rocksdb(spark)
    counter = iter(range(1000))

    def go(batches, schema, build, timers=False):
        """Feed each list of rows as one file and return everything the operator emitted."""
        source, name = tmp_path / f"in{next(counter)}", f"out{time.time_ns()}"
        source.mkdir()
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"f{i:03d}.parquet"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
        writer = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option(
            "checkpointLocation", str(tmp_path / f"cp{next(counter)}"))
        query = writer.start()
        try:
            if not timers:
                query.processAllAvailable()
            else:  # processing-time timers keep the query busy, so wait for the rows instead
                until = time.time() + 40
                while time.time() < until and spark.table(name).count() < timers:
                    time.sleep(1)
        finally:
            query.stop()
        return spark.table(name).collect()
    return go


def test_follow(run):
    schema = "chain string, seq bigint, kind string, block_index bigint, hash string"
    first = [("c", 1, "block", 5, "h5"), ("c", 2, "block", 6, "h6"), ("c", 3, "block", 6, "h6"), ("c", 4, "block", 6, "x6"), ("c", 5, "status", 7, None)]
    second = [("c", 6, "block", 9, "h9"), ("c", 7, "reorg", 12, None), ("c", 8, "reorg", 8, None), ("c", 9, "block", 8, "n8"), ("c", 10, "status", 20, None)]
    third = [("c", 11, "reorg", 1, None), ("c", 12, "block", 21, "h"), ("c", 13, "clear", None, None), ("c", 14, "block", 21, "h")]
    rows = run([first, second, third], schema, lambda s: st.follow(s, max_depth=15))
    assert [(r.verdict, r.from_block, r.to_block) for r in rows] == [
        ("catch up", 0, 5), ("apply", None, None), ("duplicate", None, None), ("fork at head", 7, 6), ("in step", None, None),
        ("catch up", 7, 9), ("ignored: above tip", None, None), ("rollback", 8, 9), ("apply", None, None), ("catch up", 9, 20),
        ("halt: too deep", None, None), ("halted", None, None), ("halt cleared", None, None), ("apply", None, None)]


def test_fork_guard(run):
    schema = "chain string, seq bigint, block_index bigint, hash string"
    show = lambda seq, heads: [("c", seq, h, v) for h, v in heads.items()]
    base = {h: f"h{h}" for h in range(1, 8)}
    changed = {**base, **{h: f"n{h}" for h in (5, 6, 7)}, 8: "n8"}
    dropped = {h: v for h, v in changed.items() if h <= 6}
    rows = run([show(1, base), show(2, changed), show(3, dropped)], schema, st.guard_forks)
    got = [(r.verdict, r.block_index) for r in rows]
    assert got[:7] == [("send", h) for h in range(1, 8)]
    assert got[7:12] == [("reorg", 5)] + [("send", h) for h in (5, 6, 7, 8)]
    assert got[12:] == [("reorg", 7)]


def test_fork_guard_starts_from_the_log(run, spark):
    """The source was reorganised at 5 while the guard was down and its state was lost."""
    schema = "chain string, seq bigint, block_index bigint, hash string"
    recorded = spark.createDataFrame([("c", h, None if h == 3 else f"h{h}") for h in range(1, 8)], "chain string, block_index bigint, hash string")
    shown = [("c", 1, h, f"h{h}" if h < 5 else f"n{h}") for h in range(1, 9)]
    seeded = [(r.verdict, r.block_index) for r in run([shown], schema, lambda s: st.guard_forks(s, recorded))]
    assert seeded == [("reorg", 5)] + [("send", h) for h in (5, 6, 7, 8)]
    same = [("c", 1, h, f"h{h}") for h in range(1, 9)]
    assert [(r.verdict, r.block_index) for r in run([same], schema, lambda s: st.guard_forks(s, recorded))] == [("send", 8)]


def test_agreement_equals_batch_twin(run, spark):
    schema = "source bigint, block_index bigint, hash string, seq bigint"
    rows = [(s, h, f"x{h}{s}" if (h * 7 + s * 3) % 5 == 0 else f"h{h}", h * 3 + s) for h in range(1, 25) for s in range(3)]
    got = {r.block_index: (r.verdict, r.hash) for r in run([rows[:30], rows[30:]], schema, lambda s: st.agree(s, 3, timeout_ms=60_000), timers=24)}
    twin = batch.agreement(spark.createDataFrame(rows, schema), ["hash"], 3).collect()
    assert got == {r.block_index: (r.verdict, r.hash) for r in twin}


@pytest.mark.parametrize("strict,verdict", [(False, "apply primary"), (True, "hold")])
def test_agreement_timeout(run, strict, verdict):
    schema = "source bigint, block_index bigint, hash string, seq bigint"
    rows = run([[(0, 7, "a", 1)]], schema, lambda s: st.agree(s, 3, strict=strict, timeout_ms=500), timers=1)
    assert [(r.block_index, r.verdict, r.hash) for r in rows] == [(7, verdict, None if strict else "a")]


def test_strikes_equal_batch_twin(run, spark):
    schema = "source bigint, block_index bigint"
    rows = [(s, h) for s in range(3) for h in range(1, 900, 37 + 60 * s)]
    rows = sorted(rows, key=lambda r: r[1])
    got = {(r.source, r.block_index): r.n_strikes for r in run([rows[:20], rows[20:]], schema, st.strike)}
    twin = batch.strike_counts(spark.createDataFrame(rows, schema)).collect()
    assert got == {(r.source, r.block_index): r.n_strikes for r in twin}
    assert {r.source for r in batch.evictions(spark.createDataFrame(twin), 3).where(F.col("evicted")).collect()} == {0}
