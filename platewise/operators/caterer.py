"""Supplier (caterer) analytics: scorecard, monthly on-time trend, tiering.

Orders are always aggregated by ``caterer_id`` before the caterer dimension is
joined (the group key is the dimension's primary key, so the result is the
same as join-then-group), which moves one row per caterer instead of one row
per order and keeps a hot caterer inside partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize
from ..sources.labels import TIER_LABELS
from . import ranking

_MICROS_PER_MINUTE = 60_000_000


def lateness_micros(orders: DataFrame) -> Column:
    """Exact lateness of a delivery in microseconds; negative means early.

    The difference of two TIMESTAMP_NTZ values is an exact day-time interval,
    whatever the session time zone (``timestamp_diff`` would go through the
    session zone and shift wall-clock times that fall in a DST gap).
    """
    interval = orders["actual_delivery"] - orders["scheduled_delivery"]
    return (interval.cast("interval second").cast("decimal(38,6)") * 1_000_000).cast("long")


def caterer_scorecard(caterers: DataFrame, orders: DataFrame, grace_minutes: int = 15) -> DataFrame:
    """Per active caterer: delivered volume, GMV, order size and on-time rates.

    Caterers without delivered orders stay in the result with 0 orders and
    NULL money and rates.
    """
    delivered = orders.filter((F.col("order_status") == "delivered") & F.col("actual_delivery").isNotNull()) \
        .select("caterer_id", "order_total_usd", "headcount", lateness_micros(orders).alias("late_us"))
    per_caterer = delivered.groupBy("caterer_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("order_total_usd").alias("gmv"),
        F.sum("headcount").alias("heads"),
        F.count("headcount").alias("heads_n"),
        F.count_if(F.col("late_us") <= 0).alias("strict"),
        F.count_if(F.col("late_us") <= grace_minutes * _MICROS_PER_MINUTE).alias("grace"),
        F.sum(F.col("late_us").cast("decimal(38,0)")).alias("late_sum"))  # a long sum could overflow
    active = caterers.filter(F.col("is_active")) \
        .select("caterer_id", "caterer_name", "cuisine_type", "avg_rating")
    n = F.col("n")
    return active.join(per_caterer, "caterer_id", "left").select(
        "caterer_name", "cuisine_type",
        F.col("avg_rating").cast("double").alias("avg_rating"),
        F.coalesce(n, F.lit(0)).cast("long").alias("total_orders"),
        C.money("gmv").alias("total_gmv_usd"),
        C.ratio(C.cents("gmv"), n * 100, 2).alias("avg_order_value_usd"),
        C.ratio("heads", "heads_n", 1).alias("avg_headcount"),
        C.pct("strict", n, 1).alias("otd_strict_pct"),
        C.pct("grace", n, 1).alias("otd_15min_grace_pct"),
        C.ratio("late_sum", n.cast("decimal(38,0)") * _MICROS_PER_MINUTE, 1).alias("avg_minutes_late"), "caterer_id",
    ).orderBy(F.col("total_gmv_usd").desc_nulls_last(), "caterer_id").drop("caterer_id")


def monthly_otd_trend(caterers: DataFrame, orders: DataFrame, window_rows: int = 3) -> DataFrame:
    """Per caterer and month: delivered orders, on-time %, rolling mean of the last rows.

    The rolling mean averages the unrounded monthly rates of the current and
    ``window_rows - 1`` preceding months that have orders (a ROWS frame), as
    decimals with 18 places, and is rounded once.  Its window is partitioned
    by caterer over at most one row per month.
    """
    delivered = orders.filter((F.col("order_status") == "delivered") & F.col("actual_delivery").isNotNull())
    monthly = delivered.groupBy("caterer_id", C.month_start("placed_at").alias("order_month")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("actual_delivery") <= F.col("scheduled_delivery")).alias("on_time"))
    frame = Window.partitionBy("caterer_id").orderBy("order_month").rowsBetween(1 - window_rows, Window.currentRow)
    rate = C.exact_rate(F.col("on_time") * 100, "orders")
    mean = F.sum(rate).over(frame) / F.count(F.lit(1)).over(frame).cast("decimal(10,0)")
    names = caterers.select("caterer_id", "caterer_name")
    return monthly.select(
        "caterer_id", "order_month", F.col("orders").cast("long").alias("orders"),
        C.pct("on_time", "orders", 1).alias("otd_pct"),
        C.rounded(mean, 1).alias("otd_3mo_rolling_avg"),
    ).join(names, "caterer_id").orderBy("caterer_name", "order_month", "caterer_id").select(
        "caterer_name", "order_month", "orders", "otd_pct", "otd_3mo_rolling_avg")


def caterer_tier(caterers: DataFrame, orders: DataFrame, weights: tuple[float, float, float] = (0.40, 0.35, 0.25),
                 num_ranges: int | None = None) -> DataFrame:
    """Composite score of GMV percentile, on-time rate and rating; quartile badge.

    ``total_orders`` and GMV count every status; the on-time denominator counts
    delivered orders.  The quartile is ``ntile(4)`` over the unrounded score
    (NULL scores last, ties broken by caterer_id); both the percentile and the
    quartile use the distributed ranking helpers.
    """
    w_gmv, w_otd, w_rating = weights
    per_caterer = orders.groupBy("caterer_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("order_total_usd").alias("gmv"),
        F.count_if(F.col("actual_delivery") <= F.col("scheduled_delivery")).alias("on_time"),
        F.count_if(F.col("order_status") == "delivered").alias("delivered"))
    stats = caterers.filter(F.col("is_active")).select("caterer_id", "caterer_name", "avg_rating") \
        .join(per_caterer, "caterer_id", "left").select(
            "caterer_id", "caterer_name",
            F.col("avg_rating").cast("double").alias("avg_rating"),
            F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("total_orders"),
            F.coalesce(F.col("gmv"), F.lit(0).cast("decimal(20,2)")).alias("gmv"),
            C.pct("on_time", "delivered", 1).alias("otd_pct"))

    # one row per caterer, read by the percentile, its join back and the quartiles:
    # materialised once so the pass over all orders is not repeated
    stats = materialize(stats)
    ranked = ranking.percent_rank(stats, "gmv", "gmv_prank", num_ranges=num_ranges)
    score = (F.lit(w_gmv) * F.col("gmv_prank")
             + F.lit(w_otd) * F.coalesce(F.col("otd_pct"), F.lit(0.0)) / F.lit(100.0)
             + F.lit(w_rating) * (F.col("avg_rating") - F.lit(1.0)) / F.lit(4.0))
    scored = ranked.withColumn("score", score)
    tiled = ranking.ntile(scored, [F.col("score").asc_nulls_last(), F.col("caterer_id").asc()], 4,
                          "quartile", num_ranges=num_ranges)
    tier = F.lit(None).cast("string")
    for q, label in TIER_LABELS.items():
        tier = F.when(F.col("quartile") == q, F.lit(label)).otherwise(tier)
    return tiled.select(
        "caterer_name", "total_orders",
        C.money("gmv").alias("total_gmv"),
        "avg_rating", "otd_pct",
        C.rounded("score", 4).alias("composite_score"),
        tier.alias("performance_tier"), "caterer_id",
    ).orderBy(F.col("composite_score").desc_nulls_first(), "caterer_id").drop("caterer_id")
