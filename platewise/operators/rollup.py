"""A stored roll-up of orders per account and day, refreshed by batch, and the reports it can answer.

Counts and sums per (account, day) add up to months, quarters, cohorts and
lifetimes, so reports need one small row for each account and day that has orders
in place of the orders.  A batch of new or changed orders rewrites the
periods it touches in both tables (:mod:`platewise.sources.stored`): stored orders are
read once, in those periods only.  Replaying a batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import buckets, schemas, stored
from . import ltv, retention, revenue

ORDERS, DAYS = "orders", "account_days"
SUMS = ("n_live", "gmv_live", "n_delivered", "gmv_delivered", "discount_delivered", "net_delivered", "stamps_live")


#: Stored orders that one task rolls up: what it holds at once is bounded by this, not by the orders stored.
ORDERS_PER_TASK = 125_000


def account_days(orders: DataFrame) -> DataFrame:
    """``(account_id, order_day)`` with counts and sums of its live (not cancelled) and delivered orders, and the
    distinct times of live ones."""
    return orders.groupBy("account_id", C.day("placed_at").alias("order_day")).agg(*_sums())


def _sums() -> list:
    live, delivered = F.col("order_status") != "cancelled", F.col("order_status") == "delivered"
    return [
        F.count_if(live).alias("n_live"), F.sum(F.when(live, F.col("order_total_usd"))).alias("gmv_live"),
        F.count_if(delivered).alias("n_delivered"), F.sum(F.when(delivered, F.col("order_total_usd"))).alias("gmv_delivered"),
        F.sum(F.when(delivered, F.col("discount_usd"))).alias("discount_delivered"),
        F.sum(F.when(delivered, F.col("order_total_usd") - F.col("discount_usd"))).alias("net_delivered"),
        F.count_distinct(F.when(live, F.col("placed_at"))).alias("stamps_live")]  # of one day, so they add up


def apply_batch(spark: SparkSession, path: str, orders: DataFrame, version: int, unit: str = "day",
                delete_when: str | None = None) -> list:
    """Store a batch of new or changed orders under ``path`` and refresh the roll-up; returns the periods refreshed.

    ``version`` numbers the batch; the rows of a refreshed period carry the
    number that refreshed it last.  ``unit`` is the width of a partition and must stay the same.  An order's
    ``placed_at`` doesn't change, so an older row of it is in the same period.
    """
    batch = orders.select([f.name for f in schemas.ORDERS.fields]).withColumn(stored.PERIOD, stored.period_of("placed_at", unit))
    periods = stored.upsert(spark, f"{path}/{ORDERS}", batch, ["order_id"], f"batch-{version}", delete_when=delete_when)
    refresh(spark, path, periods, version, unit)
    return periods


def refreshed(spark: SparkSession, path: str, periods: list, version: int, unit: str = "day") -> DataFrame:
    """The roll-up rows of some periods from the stored orders: one scan, of those partitions.

    The few columns needed move once, into the ranges that are written; the
    sums, distinct times too, are made there.  With a shuffle for each
    of these steps the wide rows of sums moved three times, and few tasks held all of them.
    """
    orders = stored.read(spark, f"{path}/{ORDERS}", stored.with_period(schemas.ORDERS)).filter(stored.in_periods(periods))
    tasks = 1 + orders.count() // ORDERS_PER_TASK  # from the files' footers
    days = orders.select("account_id", C.day("placed_at").alias("order_day"), "placed_at", "order_status", "order_total_usd",
                         "discount_usd", stored.PERIOD) \
        .repartitionByRange(tasks, stored.PERIOD, "account_id", "order_day") \
        .groupBy("account_id", "order_day", stored.PERIOD).agg(*_sums())
    return days.select("account_id", "order_day", *SUMS, F.lit(version).alias("version"), stored.PERIOD)


def refresh(spark: SparkSession, path: str, periods: list, version: int, unit: str = "day") -> None:
    """Recompute the roll-up of some periods."""
    empty = [p for p in periods if not stored.exists(spark, stored.folder(f"{path}/{ORDERS}", p))]
    for gone in empty:
        stored.delete(spark, stored.folder(f"{path}/{DAYS}", gone))
    if len(empty) < len(periods):
        stored.write_periods(refreshed(spark, path, periods, version, unit), f"{path}/{DAYS}", ["account_id", "order_day"])


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The roll-up as stored: ``account_id, order_day``, the sums, ``version`` and ``period``."""
    return stored.read(spark, f"{path}/{DAYS}")


def live_days(days: DataFrame) -> DataFrame:
    return days.filter("n_live > 0").select("account_id", "order_day", F.col("n_live").alias("n"), F.col("gmv_live").alias("gmv"))


def monthly_gmv_growth(days: DataFrame, calendar: bool = False) -> DataFrame:
    """2A from the roll-up."""
    monthly = days.filter("n_delivered > 0").groupBy(F.trunc("order_day", "month").alias("order_month")).agg(
        F.sum("n_delivered").alias("order_count"), F.sum("gmv_delivered").alias("gmv"), F.sum("discount_delivered").alias("disc"),
        F.sum("net_delivered").alias("net"))
    return revenue.growth_of_months(monthly, calendar)


def gmv_by_tier_quarter(accounts: DataFrame, days: DataFrame) -> DataFrame:
    """2C from the roll-up."""
    return revenue.tiers_of_quarters(accounts, days.filter("n_delivered > 0").groupBy(
        "account_id", F.trunc("order_day", "quarter").alias("order_quarter")).agg(
        F.sum("n_delivered").alias("n"), F.sum("gmv_delivered").alias("gmv")))


def order_cadence(accounts: DataFrame, days: DataFrame, analysis_date="2024-12-31") -> DataFrame:
    """3A from the roll-up."""
    return retention.cadence_of_days(accounts, live_days(days), analysis_date)


def cohort_retention(days: DataFrame) -> DataFrame:
    """3B from the roll-up."""
    return retention.retention_of_activity(
        live_days(days).select("account_id", F.trunc("order_day", "month").alias("activity_month")).distinct())


def churn_risk(accounts: DataFrame, days: DataFrame, analysis_date="2024-12-31", high: float = 2.0, medium: float = 1.5) -> DataFrame:
    """3C from the roll-up."""
    return retention.risk_of_days(accounts, live_days(days), analysis_date, high, medium)


def ltv_by_cohort(accounts: DataFrame, days: DataFrame, horizons=(30, 90, 180)) -> DataFrame:
    """6B from the roll-up."""
    return ltv.ltv_of_days(accounts, live_days(days), horizons)


def top_accounts_churn(accounts: DataFrame, days: DataFrame, analysis_date="2024-12-31", top_k: int = 20, multiple: int = 2,
                       min_orders: int = 3) -> DataFrame:
    """6C from the roll-up."""
    per_account = days.filter("n_live > 0").groupBy("account_id").agg(
        F.sum("gmv_live").alias("gmv"), F.sum("stamps_live").alias("distinct_ts"), F.sum("n_live").alias("n"),
        F.min("order_day").alias("first_day"), F.max("order_day").alias("last_order_date"))
    return ltv.top_of_accounts(accounts, per_account, analysis_date, top_k, multiple, min_orders)


def write_bucketed(accounts: DataFrame, days: DataFrame, path: str, count: int) -> None:
    """The accounts and the roll-up in ``count`` buckets by account, so that reports per account need no shuffle.

    It is the roll-up that is bucketed, not the orders: an account has at most
    a row for each day there, so no bucket grows with one account's orders.
    """
    buckets.write(accounts, f"{path}/accounts", "account_id", count)
    buckets.write(days.drop(stored.PERIOD), f"{path}/{DAYS}", "account_id", count, ["order_day"])


def read_bucketed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accounts and roll-up as :func:`write_bucketed` stored them."""
    return buckets.read(spark, f"{path}/accounts"), buckets.read(spark, f"{path}/{DAYS}")
