"""Retention analytics: ordering cadence, cohort retention, churn risk.

Per-account statistics are built from a partial aggregate per (account, day)
or (account, month): a hot account then costs at most one row per calendar
day, and no window ever runs over an account's raw orders.  The mean gap
between consecutive orders telescopes: the sum of the day differences of
consecutive orders is ``last_day - first_day``, so the mean is that span over
``n - 1``, an exact fraction.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import labels as L


def _not_cancelled(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("order_status") != "cancelled")


def daily_orders(orders: DataFrame) -> DataFrame:
    """(account_id, order_day) -> n orders, GMV: the per-account base of this module."""
    return orders.groupBy("account_id", C.day("placed_at").alias("order_day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("order_total_usd").alias("gmv"))


def mean_gap_days(first_day, last_day, n_orders):
    """Rounded mean of the day gaps between consecutive orders (NULL below two orders)."""
    return C.ratio_units(F.datediff(last_day, first_day), n_orders - 1, 0).cast("long")


def order_cadence(accounts: DataFrame, orders: DataFrame, analysis_date: str | dt.date = "2024-12-31") -> DataFrame:
    """Per account: lifetime orders, first/last order day, mean and latest gap, dormancy.

    ``latest_gap`` is the real gap between the last two orders in
    (placed_at, order_id) order; ``latest_gap_as_written`` keeps the source's
    expression, which is always 1.
    """
    return cadence_of_days(accounts, daily_orders(_not_cancelled(orders)), analysis_date)


def cadence_of_days(accounts: DataFrame, days: DataFrame, analysis_date: str | dt.date = "2024-12-31") -> DataFrame:
    """:func:`order_cadence` from ``(account_id, order_day, n)``."""
    # One window pass per account over its distinct order days (bounded by the
    # calendar): totals over the whole partition and the last two days by rank.
    acct = Window.partitionBy("account_id")
    w = acct.orderBy(F.col("order_day").desc())
    ranked = days.select(
        "account_id", "order_day", "n", F.row_number().over(w).alias("rn"),
        F.sum("n").over(acct).alias("lifetime_orders"),
        F.min("order_day").over(acct).alias("first_order_date"))
    per_account = ranked.filter(F.col("rn") <= 2).groupBy("account_id").agg(
        F.max("lifetime_orders").alias("lifetime_orders"),
        F.max("first_order_date").alias("first_order_date"),
        F.max(F.when(F.col("rn") == 1, F.col("order_day"))).alias("most_recent_order"),
        F.max(F.when(F.col("rn") == 1, F.col("n"))).alias("n_last"),
        F.max(F.when(F.col("rn") == 2, F.col("order_day"))).alias("prev_day"))
    last = F.col("most_recent_order")
    return per_account.join(
        accounts.select("account_id", "company_name", "account_tier"), "account_id").select(
        "account_id", "company_name", "account_tier",
        F.col("lifetime_orders").cast("long").alias("lifetime_orders"),
        "first_order_date", "most_recent_order",
        mean_gap_days(F.col("first_order_date"), last, F.col("lifetime_orders")).alias("avg_days_between_orders"),
        F.when(F.col("n_last") >= 2, F.lit(0)).otherwise(F.datediff(last, F.col("prev_day")))
         .cast("long").alias("latest_gap"),
        F.datediff(last, F.date_sub(last, 1)).cast("long").alias("latest_gap_as_written"),
        F.datediff(C.date_lit(analysis_date), last).cast("long").alias("days_since_last_order_eod"),
    ).orderBy(F.col("days_since_last_order_eod").desc_nulls_first(), "account_id")


def cohort_retention(orders: DataFrame) -> DataFrame:
    """Acquisition month x activity month: active accounts and retention %."""
    return retention_of_activity(_not_cancelled(orders).select(
        "account_id", C.month_start("placed_at").alias("activity_month")).distinct())


def retention_of_activity(activity: DataFrame) -> DataFrame:
    """:func:`cohort_retention` from the distinct ``(account_id, activity_month)``."""
    # window over one row per active month of an account: bounded by the calendar
    with_cohort = activity.withColumn(
        "cohort_month", F.min("activity_month").over(Window.partitionBy("account_id")))
    cohort_activity = with_cohort.filter(F.col("activity_month") >= F.col("cohort_month")).groupBy(
        "cohort_month", "activity_month").agg(F.count(F.lit(1)).alias("active_accounts")) \
        .withColumn("period_number", C.month_index("activity_month", "cohort_month"))
    # cohort size = the period-0 row of the same cohort; a window over at most
    # one row per activity month of the cohort, so no second pass and no join
    size = F.max(F.when(F.col("period_number") == 0, F.col("active_accounts"))) \
        .over(Window.partitionBy("cohort_month"))
    return cohort_activity.withColumn("cohort_size", size).filter(F.col("cohort_size").isNotNull()).select(
        "cohort_month",
        F.col("cohort_size").cast("long").alias("cohort_size"),
        "activity_month", "period_number",
        F.col("active_accounts").cast("long").alias("active_accounts"),
        C.pct("active_accounts", "cohort_size", 1).alias("retention_pct"),
    ).orderBy("cohort_month", "period_number")


def churn_risk(accounts: DataFrame, orders: DataFrame, analysis_date: str | dt.date = "2024-12-31",
               high: float = 2.0, medium: float = 1.5) -> DataFrame:
    """Accounts with more than one order, flagged by dormancy against their own cadence.

    Thresholds compare with the *rounded* mean gap, strictly, as in the source.
    """
    return risk_of_days(accounts, daily_orders(_not_cancelled(orders)), analysis_date, high, medium)


def risk_of_days(accounts: DataFrame, days: DataFrame, analysis_date: str | dt.date = "2024-12-31",
                 high: float = 2.0, medium: float = 1.5) -> DataFrame:
    """:func:`churn_risk` from ``(account_id, order_day, n, gmv)``."""
    per_account = days.groupBy("account_id").agg(
        F.sum("n").alias("lifetime_orders"),
        F.sum("gmv").alias("gmv"),
        F.min("order_day").alias("first_day"),
        F.max("order_day").alias("last_order_date"))
    gap = mean_gap_days(F.col("first_day"), F.col("last_order_date"), F.col("lifetime_orders"))
    dormant = F.datediff(C.date_lit(analysis_date), F.col("last_order_date")).cast("long")
    scored = per_account.filter(F.col("lifetime_orders") > 1).join(
        accounts.select("account_id", "company_name", "account_tier", "industry"), "account_id").select(
        "account_id", "company_name", "account_tier", "industry",
        F.col("lifetime_orders").cast("long").alias("lifetime_orders"),
        C.money("gmv").alias("lifetime_gmv"),
        "last_order_date",
        gap.alias("avg_days_between_orders"),
        dormant.alias("days_dormant"))
    avg = F.col("avg_days_between_orders")
    risk = F.when(F.col("days_dormant") > avg * F.lit(high), F.lit(L.CHURN_LABELS[0])) \
            .when(F.col("days_dormant") > avg * F.lit(medium), F.lit(L.CHURN_LABELS[1])) \
            .otherwise(F.lit(L.CHURN_LABELS[2]))
    rank = F.when(F.col("churn_risk") == L.CHURN_LABELS[0], 1).when(F.col("churn_risk") == L.CHURN_LABELS[1], 2) \
            .otherwise(3)
    return scored.withColumn("churn_risk", risk).orderBy(rank, F.col("lifetime_gmv").desc_nulls_first(), "account_id")
