"""Signup funnel and lifetime value: conversion by signup cohort, LTV horizons, top accounts at risk.

Accounts sign up on ``created_at`` (the source's ``signup_date``) and order
value is ``order_total_usd`` (its ``total_amount``).  Orders are rolled up per
(account, day) before they meet the accounts, and per-account figures are
aggregates, never windows over an account's raw orders.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import labels as L
from .retention import mean_gap_days


def _not_cancelled(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("order_status") != "cancelled")


def signup_funnel(accounts: DataFrame, orders: DataFrame, approx_accuracy: int | None = None) -> DataFrame:
    """6A: per signup month, accounts created and converted, rate, mean / median days to convert.

    The median is exact (``percentile``); its state is bounded by the number
    of distinct day counts, i.e. by the calendar.  ``approx_accuracy``
    switches to ``percentile_approx``.  The quality index divides the two
    rounded figures, as in the source.
    """
    first = _not_cancelled(orders).groupBy("account_id").agg(F.min("placed_at").alias("first_ts"))
    funnel = accounts.select("account_id", F.col("created_at").alias("signup_date")) \
        .join(first, "account_id", "left")
    converted = F.col("first_ts").isNotNull()
    days = F.datediff(C.day("first_ts"), F.col("signup_date"))
    g = funnel.groupBy(F.trunc("signup_date", "month").alias("signup_cohort")).agg(
        F.count(F.lit(1)).alias("created"),
        F.count_if(converted).alias("conv"),
        F.sum(days).alias("days_sum"),
        F.count(days).alias("days_n"),
        (F.percentile_approx(days, 0.5, approx_accuracy) if approx_accuracy else F.median(days))
        .alias("median_days"))
    rate_u = C.ratio_units(F.col("conv") * 100, "created", 1)
    avg_u = C.ratio_units("days_sum", "days_n", 1)
    return g.select(
        "signup_cohort",
        F.col("created").cast("long").alias("accounts_created"),
        F.col("conv").cast("long").alias("accounts_converted"),
        (rate_u.cast("double") / F.lit(10.0)).alias("conversion_rate_pct"),
        (avg_u.cast("double") / F.lit(10.0)).alias("avg_days_to_convert"),
        F.col("median_days").cast("double").alias("median_days_to_convert"),
        C.ratio(rate_u, avg_u, 2).alias("cohort_quality_index"),
    ).orderBy("signup_cohort")


def ltv_by_cohort(accounts: DataFrame, orders: DataFrame, horizons: Sequence[int] = (30, 90, 180)) -> DataFrame:
    """6B: signup month x tier: mean GMV within each horizon of signup, lifetime, orders.

    Horizons have no lower bound (orders before signup count), as written.
    ``ltv_expansion_90d_vs_30d`` divides the second horizon's mean by the first's.
    """
    daily = _not_cancelled(orders).groupBy("account_id", C.day("placed_at").alias("order_day")).agg(
        F.sum("order_total_usd").alias("gmv"), F.count(F.lit(1)).alias("n"))
    return ltv_of_days(accounts, daily, horizons)


def ltv_of_days(accounts: DataFrame, daily: DataFrame, horizons: Sequence[int] = (30, 90, 180)) -> DataFrame:
    """:func:`ltv_by_cohort` from ``(account_id, order_day, n, gmv)``."""
    base = accounts.select("account_id", "account_tier", F.col("created_at").alias("signup_date")) \
        .join(daily, "account_id", "left")
    offset = F.datediff(F.col("order_day"), F.col("signup_date"))
    zero = F.lit(0).cast("decimal(20,2)")
    per_account = base.groupBy("account_id", "account_tier", "signup_date").agg(
        *[F.coalesce(F.sum(F.when(offset <= h, F.col("gmv"))), zero).alias(f"ltv_{h}d") for h in horizons],
        F.coalesce(F.sum("gmv"), zero).alias("ltv_lifetime"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_orders"))
    names = [f"ltv_{h}d" for h in horizons] + ["ltv_lifetime"]
    g = per_account.groupBy(F.trunc("signup_date", "month").alias("signup_cohort"), "account_tier").agg(
        F.count(F.lit(1)).alias("accounts"),
        *[F.sum(c).alias(c) for c in names],
        F.sum("total_orders").alias("orders"))
    n100 = F.col("accounts") * 100
    first, second = names[0], names[1]
    return g.select(
        "signup_cohort", "account_tier",
        F.col("accounts").cast("long").alias("accounts"),
        *[C.ratio(C.cents(c), n100, 0).alias(f"avg_{c}") for c in names],
        C.ratio("orders", "accounts", 1).alias("avg_orders"),
        C.ratio(C.cents(second), C.cents(first), 2).alias(f"ltv_expansion_{horizons[1]}d_vs_{horizons[0]}d"),
    ).orderBy("signup_cohort", "account_tier")


def top_accounts_churn(accounts: DataFrame, orders: DataFrame, analysis_date: str | dt.date = "2024-12-31",
                       top_k: int = 20, multiple: int = 2, min_orders: int = 3) -> DataFrame:
    """6C: the ``top_k`` accounts by lifetime GMV in each risk partition, with churn signal and score.

    The partition of the ranking ignores ``min_orders`` while the reported
    signal applies it, as written; ties on GMV are broken by account_id.
    ``row_number() <= k`` is planned as a window group limit: each map task
    keeps its own top k per partition before the shuffle.
    """
    # (account, placed_at) roll-up: distinct timestamps and row counts in one pass
    stamps = _not_cancelled(orders).groupBy("account_id", "placed_at").agg(
        F.count(F.lit(1)).alias("n"), F.sum("order_total_usd").alias("gmv"))
    return top_of_accounts(accounts, stamps.groupBy("account_id").agg(
        F.sum("gmv").alias("gmv"),
        F.count(F.lit(1)).alias("distinct_ts"),
        F.sum("n").alias("n"),
        F.min(C.day("placed_at")).alias("first_day"),
        F.max(C.day("placed_at")).alias("last_order_date")), analysis_date, top_k, multiple, min_orders)


def top_of_accounts(accounts: DataFrame, per_account: DataFrame, analysis_date: str | dt.date = "2024-12-31",
                    top_k: int = 20, multiple: int = 2, min_orders: int = 3) -> DataFrame:
    """:func:`top_accounts_churn` from ``(account_id, gmv, distinct_ts, n, first_day, last_order_date)``."""
    summary = accounts.select("account_id", "company_name", "account_tier", "industry") \
        .join(per_account, "account_id", "left").select(
            "account_id", "company_name", "account_tier", "industry",
            F.coalesce(F.col("gmv"), F.lit(0).cast("decimal(20,2)")).alias("gmv"),
            F.coalesce(F.col("distinct_ts"), F.lit(0)).cast("long").alias("lifetime_orders"),
            "last_order_date",
            F.datediff(C.date_lit(analysis_date), F.col("last_order_date")).cast("long").alias("days_inactive"),
            mean_gap_days(F.col("first_day"), F.col("last_order_date"), F.col("n")).alias("avg_order_gap_days"))
    overdue = F.col("days_inactive") > F.col("avg_order_gap_days") * multiple
    part = F.when(overdue, F.lit(L.CHURN_SIGNALS[0])).otherwise(F.lit(L.CHURN_SIGNALS[1]))
    rank = Window.partitionBy("risk_partition").orderBy(F.col("gmv").desc(), F.col("account_id").asc())
    top = summary.filter(F.col("gmv") > 0).withColumn("risk_partition", part) \
        .withColumn("rn", F.row_number().over(rank)).filter(F.col("rn") <= top_k)
    signal = F.when(overdue & (F.col("lifetime_orders") >= min_orders), F.lit(L.CHURN_SIGNALS[0])) \
              .otherwise(F.lit(L.CHURN_SIGNALS[1]))
    score = C.ratio(C.cents("gmv") * F.col("days_inactive"), F.col("avg_order_gap_days") * 100, 0)
    return top.select(
        "account_id", "company_name", "account_tier", "industry",
        C.money("gmv").alias("lifetime_gmv"),
        "lifetime_orders", "last_order_date", "days_inactive", "avg_order_gap_days",
        signal.alias("churn_signal"),
        score.alias("outreach_priority_score"),
    ).orderBy(F.col("churn_signal").desc_nulls_first(), F.col("outreach_priority_score").desc_nulls_first())
