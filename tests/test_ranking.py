"""Distributed ranking helpers equal Spark's global windows, with ties, NULLs and a dominant value."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from platewise.operators import ranking


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        if i % 3 == 0:
            v = 500            # one value holds a third of the rows
        elif i % 97 == 0:
            v = None
        else:
            v = rng.randint(0, 400)
        rows.append((i, v, rng.randint(1, 50), rng.choice(["a", "b", "c"])))
    return spark.createDataFrame(rows, "id long, v int, w long, g string")


@pytest.mark.parametrize("num_ranges", [1, 3, 8])
def test_running_totals(data, num_ranges):
    order = [F.col("v").asc_nulls_last(), F.col("id").asc()]
    got = ranking.running_totals(data, order, {"run": F.col("w")}, num_ranges=num_ranges)
    want = data.withColumn("run", F.sum("w").over(
        Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("num_ranges", [1, 5])
def test_running_totals_partitioned(data, num_ranges):
    order = [F.col("v").desc_nulls_first(), F.col("id").asc()]
    got = ranking.running_totals(data, order, {"run": F.col("w")}, partition_by=["g"], num_ranges=num_ranges)
    want = data.withColumn("run", F.sum("w").over(
        Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("num_ranges", [2, 7])
def test_percent_rank(data, num_ranges):
    got = ranking.percent_rank(data, "v", "pr", num_ranges=num_ranges).select("id", "pr")
    want = data.select("id", F.percent_rank().over(Window.orderBy(F.col("v").asc_nulls_last())).alias("pr"))
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("tiles", [4, 7])
def test_ntile(data, tiles):
    order = [F.col("v").asc_nulls_last(), F.col("id").asc()]
    got = ranking.ntile(data, order, tiles, "t", num_ranges=5).select("id", "t")
    want = data.select("id", F.ntile(tiles).over(Window.orderBy(*order)).cast("long").alias("t"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_ntile_fewer_rows_than_tiles(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = sorted(ranking.ntile(df, [F.col("id")], 4, "t").select("id", "t").collect())
    assert [r.t for r in got] == [1, 2, 3]


def test_range_running_sum(data):
    got = ranking.range_running_sum(data, "v", "w", "cum", descending=True, num_ranges=4).select("id", "cum")
    want = data.select("id", F.sum("w").over(Window.orderBy(F.col("v").desc_nulls_first())).alias("cum"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_middle_values_give_exact_median(data):
    mid = ranking.middle_values(data, ["g"], "v", num_ranges=6)
    got = {r.g: (r._med_lo + r._med_hi) / 2 for r in mid.collect()}
    want = {r.g: r.m for r in data.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got == want


def test_ranges_stay_balanced_under_a_dominant_value(data):
    """A value held by a third of the rows is split across ranges by the tie-breaker."""
    tagged = ranking.tag_ranges(data, [F.col("v").asc_nulls_last(), F.col("id").asc()], num_ranges=6)
    spans = tagged.groupBy("_rng").agg(F.count(F.lit(1)).alias("n"),
                                       F.min(F.struct("v", "id")).alias("lo"),
                                       F.max(F.struct("v", "id")).alias("hi")).orderBy("_rng").collect()
    assert max(r.n for r in spans) <= 1.5 * 3000 / 6
    assert sum(1 for r in spans if r.lo.v == 500 or r.hi.v == 500) >= 2
