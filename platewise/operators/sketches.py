"""Distinct counts and quantiles from stored sketches, which merge to coarser grains without another pass.

``active_accounts_sketches`` keeps a HyperLogLog sketch of the accounts for each
tier and month; quarters, years and lifetime are unions of these.
``order_value_sketches`` keeps a KLL sketch of order values for each signup cohort
and month of order; any span of months, cohort or tier merges from it.  Their size
is bounded by ``lg_k`` and ``k``, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: log2 of a HyperLogLog sketch's registers, and the relative standard error that follows from it.
LG_K = 14
#: Size parameter of a KLL sketch: its rank error is about 1.3 % at 200, 0.3 % at 1,000.
KLL_K = 1000


def hll_error(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """Bound of the relative error of a distinct count, at ``deviations`` standard errors (1.04 / sqrt(registers))."""
    return deviations * 1.04 / 2 ** (lg_k / 2)


def kll_error(k: int = KLL_K) -> float:
    """Bound of the rank error of a quantile (double-sided, 99 % confidence: 2.446 / k^0.9433)."""
    return 2.446 / k ** 0.9433


def active_accounts_sketches(accounts: DataFrame, orders: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """``(account_tier, month, accounts)``: a sketch of the accounts with delivered orders, one pass over the orders."""
    active = orders.filter(F.col("order_status") == "delivered").select(
        "account_id", C.month_start("placed_at").alias("month")).distinct()
    return active.join(accounts.select("account_id", "account_tier"), "account_id").groupBy("account_tier", "month").agg(
        F.hll_sketch_agg("account_id", lg_k).alias("accounts"))


def active_accounts(sketches: DataFrame, grain: str = "month") -> DataFrame:
    """``(account_tier, period, active_accounts)`` at ``grain`` (month, quarter, year; ``lifetime``: null period), from the sketches."""
    period = F.lit(None).cast("date") if grain == "lifetime" else F.trunc("month", grain)
    return sketches.groupBy("account_tier", period.alias("period")).agg(
        F.hll_sketch_estimate(F.hll_union_agg("accounts")).alias("active_accounts"))


def order_value_sketches(accounts: DataFrame, orders: DataFrame, k: int = KLL_K) -> DataFrame:
    """``(account_tier, signup_cohort, month, n, values)``: a sketch of the values of delivered orders."""
    sold = orders.filter((F.col("order_status") == "delivered") & F.col("order_total_usd").isNotNull()).select(
        "account_id", C.month_start("placed_at").alias("month"), F.col("order_total_usd").cast("double").alias("paid"))
    cohort = accounts.select("account_id", "account_tier", F.trunc("created_at", "month").alias("signup_cohort"))
    return sold.join(cohort, "account_id").groupBy("account_tier", "signup_cohort", "month").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("paid", k).alias("values"))


def order_value_quantiles(sketches: DataFrame, by: Sequence[str], quantiles: Sequence[float] = (0.25, 0.5, 0.75, 0.9),
                          k: int = KLL_K) -> DataFrame:
    """Quantiles of order values per ``by`` (any of the sketches' keys, or none), from merged sketches."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("values", k).alias("merged"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("merged", F.lit(q)).alias(f"p{round(100 * q)}") for q in quantiles])
