"""What a task holds doesn't grow with the tables, and large steps shuffle no more than they need."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from blockloom import session
from blockloom.operators import aggregates as agg
from blockloom.operators import integrity, ordered_hash, smt
from blockloom.sources.driver_model import DriverModel

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_parts(monkeypatch):
    """The small tables count as large ones."""
    monkeypatch.setattr(session, "PART_BYTES", 4_000)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_ledger_join_has_more_tasks_for_more_input(spark, small_parts):
    ledger = DriverModel(spark, SF).ledger_base
    parts = session.part_count(spark.read.parquet(f"{SF}/lineitem.parquet"))
    assert parts > session.task_count(spark) and "hashpartitioning(l_orderkey" in plan_of(ledger) and f", {parts}), REPARTITION_BY_NUM" in plan_of(ledger)
    keys = spark.read.parquet(f"{SF}/orders.parquet")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert ledger.count() == lines.join(keys, F.col("l_orderkey") == F.col("o_orderkey")).count()


def test_scoped_balances_pick_keys_from_sums(spark):
    rows = spark.createDataFrame([(1, 1, "5"), (1, 1, "2.5"), (2, 1, "1"), (3, 1, "7")], "address_id bigint, tick_id bigint, amount string")
    spent = spark.createDataFrame([(3, 1, "7"), (1, 1, "0.5")], rows.schema)
    existing = spark.createDataFrame([(2, 1, "1"), (3, 1, "9")], rows.schema)
    touched = spark.createDataFrame([(1, 1), (3, 1), (9, 9)], "address_id bigint, tick_id bigint")
    got = agg.balances_scoped(existing, rows, spent, touched)
    assert sorted(map(tuple, got.collect())) == [(1, 1, "7"), (2, 1, "1")]
    optimized = got._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("LeftSemi") == 1  # before, one pick from the credits and one from the debits


def test_sums_that_carry_and_sums_that_need_not(spark):
    cases = {1: ["0.1", "-0.1"], 2: ["-999999", "0.000000000000000001"], 3: ["999999999999999999", "1"], 4: ["0.5", None], 5: [None], 6: ["-0.5", "0.25"]}
    rows = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k int, v string")
    from blockloom.functions import decimals as D
    got = {r.k: (r.s, r.s_nonzero) for r in D.exact_sum(rows, ["k"], "v", "s").collect()}
    assert got == {1: ("0", False), 2: ("-999998.999999999999999999", True), 3: ("1000000000000000000", True), 4: ("0.5", True), 5: ("0", False), 6: ("-0.25", True)}


def test_reachable_nodes_stay_where_they_lie(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(smt, "materialise", lambda df: steps.append(plan_of(df)) or session.materialise(df))
    rows = [("a", "b", "c"), ("b", "d", None), ("c", "d", "gone"), ("d", "a", None), ("x", "a", None), ("a", "b", "c")]
    nodes = spark.createDataFrame(rows, "node_hash string, left_hash string, right_hash string")
    roots = spark.createDataFrame([("a",), ("none",)], "node_hash string")
    assert sorted(r.node_hash for r in smt.reachable_nodes(nodes, roots).collect()) == ["a", "b", "c", "d"]
    assert steps and all("InMemoryRelation" in p for p in steps)
    with pytest.raises(ValueError):
        smt.reachable_nodes(nodes, roots, max_levels=1)


def test_ledger_rows_travel_without_their_text(spark):
    rows = spark.createDataFrame([(1, 10, "a", "T", "5")], "block_index bigint, action_index bigint, address string, tick string, amount string")
    assert integrity._block_fragments({"credits": rows}, True)[0].first().row is None
    wide = rows.withColumn("amount", F.col("amount").cast("decimal(9,2)"))  # shown as a number, sorted as text
    assert '"amount":5.00' in integrity._block_fragments({"credits": wide}, True)[0].first().row


@pytest.mark.parametrize("kept", [0, 1 << 20])
def test_groups_whole_in_a_task_are_hashed_there(spark, monkeypatch, kept):
    import pandas as pd
    monkeypatch.setattr(ordered_hash, "KEPT_CHARS", kept)
    monkeypatch.setattr(ordered_hash, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    layout = ordered_hash.Layout("k", (ordered_hash.Segment(0, "[", "]"),))
    rows = [(b, "k", 0, f"{b}-{i}") for b in range(5) for i in range(3)] + [(b, "k", ordered_hash.TAIL, "!") for b in range(4)]
    rows = sorted(rows, key=lambda r: r[:1] + r[2:])
    frames = [pd.DataFrame(list(g), columns=["block_index", "kind", "part", "row"]) for _, g in itertools.groupby(enumerate(rows), lambda x: x[0] // 2) for g in [[r for _, r in g]]]
    out = pd.concat(ordered_hash._chunks({"k": layout})(iter(frames)))
    done = out[out["part"] == ordered_hash.DONE]
    assert dict(zip(done["block_index"], done["text"])) == ({} if not kept else {b: hashlib.sha256(f"[{b}-0,{b}-1,{b}-2]!".encode()).hexdigest() for b in (1, 2, 3)})
    again = pd.concat(ordered_hash._hasher({"k": layout}, None)(iter([out.sort_values(["kind", "block_index", "part", "run", "seq"])])))
    assert dict(zip(again["block_index"], again["hash"])) == {b: hashlib.sha256(f"[{b}-0,{b}-1,{b}-2]!".encode()).hexdigest() for b in range(4)}



def test_digest_is_counted_in_more_tasks_for_more_input(spark, monkeypatch):
    df = DriverModel(spark, SF).table("orders").select("o_custkey", "o_orderstatus").where("o_custkey < 40")
    df = df.unionByName(df).unionByName(df.limit(1))
    want = integrity.content_digests({"t": df}).collect()
    monkeypatch.setattr(session, "PART_BYTES", 1_000)
    parts = session.part_count(df)
    got = integrity.content_digests({"t": df})
    assert parts > session.task_count(spark) and plan_of(got).count(f", {parts}), REPARTITION_BY_NUM") >= 2
    assert got.collect() == want
