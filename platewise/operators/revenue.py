"""Revenue analytics: monthly GMV growth, revenue concentration, tier x quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize
from ..sources import labels as L
from . import ranking


def monthly_gmv_growth(orders: DataFrame, calendar: bool = False) -> DataFrame:
    """Delivered orders per month with MoM / YoY growth and cumulative GMV.

    ``LAG(12)`` is twelve rows back (months without orders have no row), as in
    the source.  With ``calendar=True`` a month spine from the first to the
    last month is joined first, so empty months appear with zero orders and
    GMV, and twelve rows back is twelve months back.  The window runs over the
    monthly aggregate: one row per calendar month, so its single partition is
    bounded by the calendar.
    """
    monthly = orders.filter(F.col("order_status") == "delivered").groupBy(
        C.month_start("placed_at").alias("order_month")).agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum("order_total_usd").alias("gmv"),
        F.sum("discount_usd").alias("disc"),
        F.sum(F.col("order_total_usd") - F.col("discount_usd")).alias("net"))
    return growth_of_months(monthly, calendar)


def growth_of_months(monthly: DataFrame, calendar: bool = False) -> DataFrame:
    """:func:`monthly_gmv_growth` from ``(order_month, order_count, gmv, disc, net)``."""
    if calendar:
        span = monthly.agg(F.min("order_month").alias("lo"), F.max("order_month").alias("hi"))
        spine = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("order_month"))
        zero = F.lit(0).cast("decimal(20,2)")
        monthly = spine.join(monthly, "order_month", "left").select(
            "order_month", F.coalesce("order_count", F.lit(0)).alias("order_count"),
            *[F.coalesce(c, zero).alias(c) for c in ("gmv", "disc", "net")])
    w = Window.orderBy("order_month")
    g = C.cents("gmv")
    prev, prev12 = F.lag(g, 1).over(w), F.lag(g, 12).over(w)
    return monthly.select(
        "order_month",
        F.col("order_count").cast("long").alias("order_count"),
        C.money("gmv").alias("gmv_usd"),
        C.money("disc").alias("total_discounts_usd"),
        C.money("net").alias("net_revenue_usd"),
        C.ratio((g - prev) * 100, prev, 1).alias("mom_growth_pct"),
        C.ratio((g - prev12) * 100, prev12, 1).alias("yoy_growth_pct"),
        C.money(F.sum("gmv").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
         .alias("cumulative_gmv_usd"),
    ).orderBy("order_month")


def revenue_pareto(accounts: DataFrame, orders: DataFrame, threshold: int = 80,
                   num_ranges: int | None = None) -> DataFrame:
    """Share of delivered GMV per account and the running share from the top.

    The running share uses the RANGE frame of ``ORDER BY total_gmv DESC`` (tied
    accounts share it) and is computed with the distributed running sum; the
    grand total is read off the same per-range table.  Accounts whose *rounded* running share
    is at most ``threshold`` are flagged.
    """
    per_account = orders.filter(F.col("order_status") == "delivered").groupBy("account_id").agg(
        F.sum("order_total_usd").alias("total_gmv"),
        F.count(F.lit(1)).alias("total_orders"))
    # one row per account, read by the running sum and its join back: materialised
    # once so the pass over all orders is not repeated
    base = materialize(accounts.select("account_id", "company_name", "account_tier", "industry")
                       .join(per_account, "account_id"))
    with_cum = ranking.range_running_sum(base, "total_gmv", "total_gmv", "cum_gmv", descending=True,
                                         num_ranges=num_ranges, total="grand_gmv")
    cum_pct = C.ratio(C.cents("cum_gmv") * 100, C.cents("grand_gmv"), 1)
    return with_cum.select(
        "company_name", "account_tier", "industry",
        F.col("total_orders").cast("long").alias("total_orders"),
        C.money("total_gmv").alias("total_gmv"),
        C.ratio(C.cents("total_gmv") * 100, C.cents("grand_gmv"), 2).alias("gmv_share_pct"),
        cum_pct.alias("cumulative_gmv_pct"),
        F.when(cum_pct <= threshold, F.lit(L.PARETO_TOP.format(threshold=threshold))).otherwise(F.lit(L.PARETO_TAIL))
         .alias("gmv_segment"), "account_id",
    ).orderBy(F.col("total_gmv").desc_nulls_first(), "account_id").drop("account_id")


def gmv_by_tier_quarter(accounts: DataFrame, orders: DataFrame) -> DataFrame:
    """Tier x quarter: active accounts, orders, GMV, order value, orders per account.

    Orders are first rolled up per (account, quarter), so the distinct-account
    count becomes a plain count and only that roll-up meets the accounts.
    """
    per_account = orders.filter(F.col("order_status") == "delivered").groupBy(
        "account_id", C.quarter_start("placed_at").alias("order_quarter")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("order_total_usd").alias("gmv"))
    return tiers_of_quarters(accounts, per_account)


def tiers_of_quarters(accounts: DataFrame, per_account: DataFrame) -> DataFrame:
    """:func:`gmv_by_tier_quarter` from one ``(account_id, order_quarter, n, gmv)`` for each account and quarter."""
    tiers = accounts.select("account_id", "account_tier")
    g = per_account.join(tiers, "account_id").groupBy("account_tier", "order_quarter").agg(
        F.count(F.lit(1)).alias("active_accounts"),
        F.sum("n").alias("total_orders"),
        F.sum("gmv").alias("gmv"))
    return g.select(
        "account_tier", "order_quarter",
        F.col("active_accounts").cast("long").alias("active_accounts"),
        F.col("total_orders").cast("long").alias("total_orders"),
        C.money("gmv").alias("gmv_usd"),
        C.ratio(C.cents("gmv"), F.col("total_orders") * 100, 2).alias("avg_order_value_usd"),
        C.ratio("total_orders", "active_accounts", 2).alias("orders_per_account"),
    ).orderBy("order_quarter", C.tier_rank("account_tier"))
