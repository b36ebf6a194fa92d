"""Exact rounding helpers agree with decimal arithmetic."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platewise.functions import columns as C


def _expected(n, d, k):
    if d == 0:
        return None
    x = Decimal(n) / Decimal(d)
    q = abs(x).quantize(Decimal(1).scaleb(-k), rounding=ROUND_HALF_UP)
    return float(q if x >= 0 else -q)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**12, 10**12), st.integers(-10**6, 10**6)), min_size=50, max_size=300))
def test_ratio_is_exact(spark, pairs):
    pairs = pairs + [(1005, 1000), (-25, 10), (25, 10), (15, 10), (1, 3), (2, 3), (7, 0)]
    df = spark.createDataFrame(pairs, "n long, d long")
    got = df.select("n", "d", *[C.ratio("n", "d", k).alias(f"r{k}") for k in (0, 1, 2, 4)]).collect()
    for row in got:
        exp = tuple(_expected(row.n, row.d, k) for k in (0, 1, 2, 4))
        assert (row.r0, row.r1, row.r2, row.r4) == exp


def test_rounded_and_dates(spark):
    df = spark.createDataFrame([(0.125, "2023-12-31 23:59:00", "2024-01-01 00:01:00")],
                               "x double, a string, b string").select(
        "x", F.to_timestamp_ntz("a").alias("a"), F.to_timestamp_ntz("b").alias("b"))
    r = df.select(C.rounded("x", 2).alias("h"), C.rounded(-F.col("x"), 2).alias("low"), C.days_between("a", "b").alias("d"),
                  C.month_index(C.month_start("b"), C.month_start("a")).alias("m")).first()
    assert r.h == 0.13 and r.low == -0.13  # away from zero on both sides
    assert r.d == 1      # one day boundary crossed, though only two minutes apart
    assert r.m == 1      # December -> January across the year change


def test_tier_rank_orders_by_declaration(spark):
    df = spark.createDataFrame([("enterprise",), ("smb",), ("mid_market",)], "t string")
    assert [r.t for r in df.orderBy(C.tier_rank("t")).collect()] == ["smb", "mid_market", "enterprise"]


def test_ratio_is_exact_beyond_long_range(spark):
    """Money products (cents x days) can pass 2**63; the rounding stays exact."""
    big = [(10 ** 25 + 7, 3), (-(10 ** 24) - 5, 10), (9 * 10 ** 22, 7)]
    df = spark.createDataFrame([(str(n), d) for n, d in big], "n string, d long") \
        .select(F.col("n").cast("decimal(38,0)").alias("n"), "d")
    got = [r.u for r in df.select(C.ratio_units("n", "d", 2).alias("u")).collect()]
    want = []
    for n, d in big:
        x = Decimal(n) * 100 / Decimal(d)
        q = abs(x).quantize(Decimal(1), rounding=ROUND_HALF_UP)
        want.append(q if x >= 0 else -q)
    assert [int(g) for g in got] == [int(w) for w in want]
