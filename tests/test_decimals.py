"""Exact wide decimals against Python's decimal module."""

from decimal import ROUND_HALF_UP, Decimal, getcontext

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.functions import decimals as D

getcontext().prec = 120
AMOUNT = st.tuples(st.integers(-(10**47), 10**47), st.integers(0, 18)).map(
    lambda t: f"{Decimal(t[0]).scaleb(-t[1]):f}")


def plain(value: Decimal) -> str:
    text = f"{value:f}"
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), AMOUNT), min_size=1, max_size=40))
def test_exact_sum(spark, rows):
    got = {r.k: (r.v, r.v_nonzero) for r in D.exact_sum(spark.createDataFrame(rows, "k int, a string"), ["k"], "a", "v").collect()}
    for k in {r[0] for r in rows}:
        want = sum((Decimal(a) for i, a in rows if i == k), Decimal(0))
        assert got[k] == (plain(want), want != 0)


def test_carry_edges(spark):
    rows = [(1, "0.999999999999999999"), (1, "0.000000000000000001"), (2, "-0.000000000000000001"), (3, "9" * 38), (3, "1"),
            (4, "-1"), (4, "0.000000000000000001"), (5, "999999999999999999.999999999999999999")]
    got = {r.k: r.v for r in D.exact_sum(spark.createDataFrame(rows, "k int, a string"), ["k"], "a", "v").collect()}
    assert got == {1: "1", 2: "-0.000000000000000001", 3: "1" + "0" * 38, 4: "-0.999999999999999999", 5: "999999999999999999.999999999999999999"}


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(AMOUNT, st.integers(0, 18)), min_size=1, max_size=30))
def test_rounding(spark, rows):
    df = spark.createDataFrame([(i, a, d) for i, (a, d) in enumerate(rows)], "i int, a string, d int")
    summed = D.with_limbs(df, "a", "s").groupBy("i", "d").agg(*D.limb_sums("s"))
    out = D.round_settled(D.settle(summed, "s"), "s", "d").select("i", D.minimal_text("s").alias("v")).collect()
    for r in out:
        a, d = rows[r.i]
        assert r.v == plain(Decimal(a).quantize(Decimal(1).scaleb(-d), rounding=ROUND_HALF_UP))


@pytest.mark.parametrize("text,want", [
    ("0", "0.000000000000000000"), ("1000.5", "1000.500000000000000000"), ("00042", "42.000000000000000000"),
    ("0.000000000000000001", "0.000000000000000001"), ("7777777.123456789012345678", "7777777.123456789012345678")])
def test_canonical(spark, text, want):
    assert spark.createDataFrame([(text,)], "a string").select(D.canonical_amount(F.col("a"))).first()[0] == want


@pytest.mark.parametrize("text", ["-1", "1e5", "1.", ".5", "1.0000000000000000001", "", "abc"])
def test_canonical_rejects(spark, text):
    with pytest.raises(Exception, match="non-canonical"):
        spark.createDataFrame([(text,)], "a string").select(D.canonical_amount(F.col("a"))).collect()


def test_sum_rejects_text(spark):
    with pytest.raises(Exception, match="not a decimal amount"):
        D.exact_sum(spark.createDataFrame([(1, "1e3")], "k int, a string"), ["k"], "a", "v").collect()
