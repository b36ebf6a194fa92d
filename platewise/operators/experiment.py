"""A/B experiment analytics: enrollment, per-account outcomes and the reports on them.

``experiment_results`` builds one row per enrolled account; the reports
(conversion, GMV, segment cuts, sample-ratio check, cancellation guardrail)
take that DataFrame.  When several reports run on one result, persist it once
with :func:`persist_results` (a reliable checkpoint in the cluster's shared
checkpoint folder), so lineage is cut and a lost executor does not recompute
the enrollment.

Money stays exact (decimal) in the result so report sums do not depend on
partition order; :func:`results_report` gives the display form.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import labels as L
from ..session import materialize
from . import ranking


def first_assignment(assignments: DataFrame, experiment: str,
                     start: str | dt.date | None = None, end: str | dt.date | None = None) -> DataFrame:
    """Earliest assignment per account (ties: lowest assignment_id) in an optional [start, end).

    A partial + final ``min`` over a struct instead of a window over each
    account's rows: retries of a hot account are reduced before the shuffle.
    """
    cond = F.col("experiment_name") == experiment
    if start is not None:
        cond = cond & (F.col("assigned_at") >= C.ts_lit(start))
    if end is not None:
        cond = cond & (F.col("assigned_at") < C.ts_lit(end))
    first = assignments.filter(cond).groupBy("account_id").agg(
        F.min(F.struct("assigned_at", "assignment_id", "variant", "experiment_name")).alias("f"))
    return first.select("account_id", "f.experiment_name", "f.variant", "f.assigned_at")


def experiment_cohort(assignments: DataFrame, accounts: DataFrame, experiment: str = "SPRING20") -> DataFrame:
    """The enrolled accounts: first assignment, enrollment day and account attributes, one row each."""
    return first_assignment(assignments, experiment).select(
        "account_id", "variant", C.day("assigned_at").alias("enrollment_date")) \
        .join(accounts.select("account_id", "account_tier", "industry", "created_at"), "account_id")


#: Days of a bin: an account's orders meet the cohort bin by bin.
BIN_DAYS = 7


def _bin(day):
    return F.floor(F.datediff(day, F.lit(dt.date(1970, 1, 1))) / BIN_DAYS).cast("int")


def cohort_orders(orders: DataFrame, cohort: DataFrame, horizon_days: int) -> DataFrame:
    """Orders of the cohort's accounts in the weeks from their enrollment to ``horizon_days`` after it.

    An order meets its account's weeks in a semi join by account and week: what
    is outside them goes before any roll-up, and an account with very many
    orders is shuffled as its weeks, not as one key.  The weeks hold the
    horizon and at most a few days more, so callers still compare days.

    The span of all enrollments is one scalar subquery over the small cohort, planned with the
    query and evaluated before the scan of the orders.  The cohort
    is read several times: pass it materialised (:func:`persist_results`).
    """
    span = cohort.agg(F.struct(F.min("enrollment_date").cast("timestamp_ntz").alias("lo"),
                               F.date_add(F.max("enrollment_date"), horizon_days + 1).cast("timestamp_ntz").alias("hi"))).scalar()
    weeks = cohort.select(F.col("account_id").alias("_account"), F.explode(F.sequence(
        _bin(F.col("enrollment_date")), _bin(F.date_add("enrollment_date", horizon_days)))).alias("_week"))
    return orders.filter((F.col("placed_at") >= span["lo"]) & (F.col("placed_at") < span["hi"])) \
        .join(weeks, (F.col("account_id") == F.col("_account")) & (_bin(C.day("placed_at")) == F.col("_week")), "left_semi")


def experiment_enrollment(assignments: DataFrame, accounts: DataFrame, experiment: str = "SPRING20",
                          start: str | dt.date = "2024-03-01", end: str | dt.date = "2024-06-01") -> DataFrame:
    """A1: first assignment inside [start, end) per account, with account attributes."""
    first = first_assignment(assignments, experiment, start, end)
    return first.join(accounts.select("account_id", "account_tier", "industry", "city"), "account_id").select(
        "account_id", "experiment_name", "variant",
        C.day("assigned_at").alias("assignment_date"),
        "account_tier", "industry", "city")


def experiment_results(assignments: DataFrame, accounts: DataFrame, orders: DataFrame,
                       experiment: str = "SPRING20", conv_days: int = 30, gmv_days: int = 60) -> DataFrame:
    """A2: per enrolled account, conversion within ``conv_days`` and GMV within ``gmv_days``.

    The cohort is derived once and stored (:func:`persist_results`), then followed by :func:`results_of_cohort`.
    """
    return results_of_cohort(persist_results(experiment_cohort(assignments, accounts, experiment)), orders, conv_days, gmv_days)


def results_of_cohort(cohort: DataFrame, orders: DataFrame, conv_days: int = 30, gmv_days: int = 60) -> DataFrame:
    """:func:`experiment_results` of a cohort, best a materialised one.

    The cohort's delivered orders are rolled up per (account, day); the roll-up
    is joined to the cohort and both horizons are evaluated on it as day
    ranges (``enrollment <= day <= enrollment + N``), in one pass.
    ``first_order_value`` is the smallest order value in the window, as
    written; ``first_order_value_true`` is the value of the earliest order.
    """
    daily = cohort_orders(orders.filter(F.col("order_status") == "delivered"), cohort,
                          max(conv_days, gmv_days)).groupBy(
        "account_id", C.day("placed_at").alias("order_day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("order_total_usd").alias("gmv"),
        F.min("order_total_usd").alias("smallest"),
        F.min(F.struct("placed_at", "order_id", "order_total_usd")).alias("earliest"))
    # The cohort meets its order days once (left join keeps accounts without
    # orders); the windows are conditions inside the aggregates.
    offset = F.datediff(F.col("order_day"), F.col("enrollment_date"))
    in_conv = (offset >= 0) & (offset <= conv_days)
    in_gmv = (offset >= 0) & (offset <= gmv_days)
    keys = ["account_id", "variant", "enrollment_date", "account_tier", "industry", "created_at"]
    outcomes = cohort.join(daily, "account_id", "left").groupBy(*keys).agg(
        F.min(F.when(in_conv, F.col("order_day"))).alias("first_order_date"),
        F.min(F.when(in_conv, F.col("smallest"))).alias("first_order_value"),
        F.min(F.when(in_conv, F.col("earliest"))).alias("earliest"),
        F.sum(F.when(in_gmv, F.col("gmv"))).alias("gmv_60d"),
        F.sum(F.when(in_gmv, F.col("n"))).alias("orders_60d"))
    zero = F.lit(0).cast("decimal(10,2)")
    return outcomes.select(
        *keys,
        F.when(F.col("first_order_date").isNotNull(), 1).otherwise(0).cast("long").alias("converted"),
        "first_order_date",
        F.datediff(F.col("first_order_date"), F.col("enrollment_date")).cast("long").alias("days_to_first_order"),
        F.coalesce(F.col("first_order_value"), zero).alias("first_order_value"),
        F.coalesce(F.col("gmv_60d"), zero).alias("gmv_60d"),
        F.coalesce(F.col("orders_60d"), F.lit(0)).cast("long").alias("orders_60d"),
        F.coalesce(F.col("earliest.order_total_usd"), zero).alias("first_order_value_true"))


def results_report(results: DataFrame) -> DataFrame:
    """Display form of :func:`experiment_results` (money as double, without the account's creation day)."""
    return results.select(*[C.money(c).alias(c) if c in ("first_order_value", "gmv_60d", "first_order_value_true")
                            else F.col(c) for c in results.columns if c != "created_at"])


def persist_results(results: DataFrame) -> DataFrame:
    """Materialise the result once for the reports (reliable checkpoint, lineage cut)."""
    return materialize(results)


def conversion_by_variant(results: DataFrame, z: float = 1.96) -> DataFrame:
    """B1: conversion rate per variant, normal-approximation margin and Wilson bounds."""
    return conversion_of(results.groupBy("variant").agg(*_measures("n", "conv", "sd_conv")), z)


def conversion_of(g: DataFrame, z: float = 1.96) -> DataFrame:
    """B1 from ``(variant, n, conv, sd_conv)``."""
    n = F.col("n").cast("double")
    p = F.col("conv").cast("double") / n
    z2 = F.lit(z * z)
    denom = F.lit(1.0) + z2 / n
    centre = (p + z2 / (F.lit(2.0) * n)) / denom
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + z2 / (F.lit(4.0) * n * n)) / denom
    return g.select(
        "variant",
        F.col("n").cast("long").alias("n_accounts"),
        F.col("conv").cast("long").alias("conversions"),
        C.pct("conv", "n", 2).alias("conversion_rate_pct"),
        C.rounded(F.col("sd_conv") / F.sqrt(n) * F.lit(z) * F.lit(100.0), 2).alias("margin_of_error_pct"),
        C.rounded((centre - half) * F.lit(100.0), 2).alias("wilson_low_pct"),
        C.rounded((centre + half) * F.lit(100.0), 2).alias("wilson_high_pct"),
    ).orderBy("variant")


def gmv_by_variant(results: DataFrame, num_ranges: int | None = None,
                   approx_accuracy: int | None = None) -> DataFrame:
    """B2: converter order value; mean, median, sd and total of window GMV per variant.

    The median is exact by default (distributed ranks over distinct values);
    ``approx_accuracy`` switches to ``percentile_approx``, one pass with
    per-group state bounded by the accuracy, for very large variants.  The
    result is read twice: pass it materialised (:func:`persist_results`).
    """
    aggs = _measures("n", "conv", "fov", "gmv", "sd_gmv")
    if approx_accuracy:
        median = F.percentile_approx("gmv_60d", 0.5, approx_accuracy)
        g = results.groupBy("variant").agg(*aggs, median.alias("_med_lo"), median.alias("_med_hi"))
    else:
        g = results.groupBy("variant").agg(*aggs).join(
            ranking.middle_values(results, ["variant"], "gmv_60d", num_ranges=num_ranges), "variant", "left")
    return gmv_of(g)


def gmv_of(g: DataFrame) -> DataFrame:
    """B2 from ``(variant, n, conv, fov, gmv, sd_gmv)`` and the middle values ``_med_lo, _med_hi``."""
    return g.select(
        "variant",
        F.col("n").cast("long").alias("n_accounts"),
        F.col("conv").cast("long").alias("n_converters"),
        C.ratio(C.cents("fov"), F.col("conv") * 100, 2).alias("avg_first_order_gmv"),
        C.ratio(C.cents("gmv"), F.col("n") * 100, 2).alias("avg_gmv_60d"),
        C.ratio(C.cents("_med_lo") + C.cents("_med_hi"), F.lit(200), 2).alias("median_gmv_60d"),
        C.rounded(F.col("sd_gmv"), 2).alias("stddev_gmv_60d"),
        C.money("gmv").alias("total_gmv_60d"),
    ).orderBy("variant")


def _measures(*names: str) -> list:
    """Aggregates of the per-account result that the reports are made of."""
    every = {"n": F.count(F.lit(1)), "conv": F.sum("converted"), "sd_conv": F.stddev_samp("converted"),
             "fov": F.sum(F.when(F.col("converted") == 1, F.col("first_order_value"))),
             "gmv": F.sum("gmv_60d"), "sd_gmv": F.stddev_samp("gmv_60d"),
             "pre_sum": F.sum("pre_orders"), "pre_n": F.count("pre_orders")}
    return [every[name].alias(name) for name in names]


def _segment_metrics(df: DataFrame, segment: str) -> DataFrame:
    return df.groupBy(segment, "variant").agg(*_measures("n", "conv", "gmv"))


def results_by_tier(results: DataFrame, control: str = "control") -> DataFrame:
    """C1: tier x variant conversion and GMV, with two lifts.

    ``lift_vs_tier_mean_pp`` is the source's expression (rate minus the mean
    rate of all variants in the tier); ``lift_vs_control_pp`` is rate minus the
    control variant's rate in the tier, exact.  Windows run over the tiny
    tier x variant aggregate.
    """
    return tiers_of(_segment_metrics(results, "account_tier"), control)


def tiers_of(g: DataFrame, control: str = "control") -> DataFrame:
    """C1 from ``(account_tier, variant, n, conv, gmv)``."""
    tier = Window.partitionBy("account_tier")
    rate = C.exact_rate(F.col("conv") * 100, "n")
    mean = F.sum(rate).over(tier) / F.count(F.lit(1)).over(tier).cast("decimal(10,0)")
    dec = "decimal(38,0)"  # products of counts: exact, no long overflow
    c_conv = F.max(F.when(F.col("variant") == control, F.col("conv"))).over(tier).cast(dec)
    c_n = F.max(F.when(F.col("variant") == control, F.col("n"))).over(tier).cast(dec)
    lift_num = (F.col("conv").cast(dec) * c_n - c_conv * F.col("n").cast(dec)) * 100
    return g.select(
        "account_tier", "variant",
        F.col("n").cast("long").alias("n_accounts"),
        C.pct("conv", "n", 2).alias("conversion_rate_pct"),
        C.ratio(C.cents("gmv"), F.col("n") * 100, 2).alias("avg_gmv_60d"),
        C.rounded(rate - mean, 2).alias("lift_vs_tier_mean_pp"),
        C.ratio(lift_num, F.col("n").cast(dec) * c_n, 2).alias("lift_vs_control_pp"),
    ).orderBy("account_tier", "variant")


def power_users(results: DataFrame, orders: DataFrame, launch: str | dt.date = "2024-03-01",
                lookback_days: int = 90, min_orders: int = 4) -> DataFrame:
    """C2: power users (>= min_orders delivered orders in the lookback before launch) vs others."""
    g = with_power_users(results, orders, launch, lookback_days, min_orders).groupBy("user_segment", "variant").agg(
        *_measures("n", "conv", "gmv", "pre_sum", "pre_n"))
    return power_of(g)


def with_power_users(results: DataFrame, orders: DataFrame, launch: str | dt.date, lookback_days: int, min_orders: int) -> DataFrame:
    """``results`` with ``pre_orders`` (power users only) and ``user_segment``."""
    launch_day = dt.date.fromisoformat(launch) if isinstance(launch, str) else launch
    start = launch_day - dt.timedelta(days=lookback_days)
    pre = orders.filter((F.col("order_status") == "delivered")
                        & (F.col("placed_at") >= C.ts_lit(start)) & (F.col("placed_at") < C.ts_lit(launch_day))) \
        .groupBy("account_id").agg(F.count(F.lit(1)).alias("pre_orders")) \
        .filter(F.col("pre_orders") >= min_orders)
    seg = F.when(F.col("pre_orders").isNotNull(), F.lit(L.POWER_USER)).otherwise(F.lit(L.REGULAR_USER))
    return results.join(pre, "account_id", "left").withColumn("user_segment", seg)


def power_of(g: DataFrame) -> DataFrame:
    """C2 from ``(user_segment, variant, n, conv, gmv, pre_sum, pre_n)``."""
    return g.select(
        "user_segment", "variant",
        F.col("n").cast("long").alias("n_accounts"),
        C.pct("conv", "n", 2).alias("conversion_rate_pct"),
        C.ratio(C.cents("gmv"), F.col("n") * 100, 2).alias("avg_gmv_60d"),
        C.ratio("pre_sum", "pre_n", 1).alias("avg_pre_exp_orders"),
    ).orderBy("user_segment", "variant")


def account_age(results: DataFrame) -> DataFrame:
    """C3: new (< 60 d) / growing (< 180 d) / established accounts at enrollment x variant."""
    return ages_of(_segment_metrics(results.withColumn("account_age_segment", age_segment()), "account_age_segment"))


def age_segment():
    age = F.datediff(F.col("enrollment_date"), F.col("created_at"))
    return F.when(age < 60, F.lit(L.AGE_LABELS[0])).when(age < 180, F.lit(L.AGE_LABELS[1])).otherwise(F.lit(L.AGE_LABELS[2]))


def ages_of(g: DataFrame) -> DataFrame:
    """C3 from ``(account_age_segment, variant, n, conv, gmv)``."""
    return g.select(
        "account_age_segment", "variant",
        F.col("n").cast("long").alias("n_accounts"),
        C.pct("conv", "n", 2).alias("conversion_rate_pct"),
        C.ratio(C.cents("gmv"), F.col("n") * 100, 2).alias("avg_gmv_60d"),
    ).orderBy("account_age_segment", "variant")


def srm_check(cohort: DataFrame, expected_share: float = 0.5, tolerance: float = 0.02) -> DataFrame:
    """D: enrolled accounts per variant, share of total, flag when off the expected share.

    Takes the cohort, or results, whose rows are the cohort's.
    """
    return srm_of(cohort.groupBy("variant").agg(F.count(F.lit(1)).alias("n")), expected_share, tolerance)


def srm_of(g: DataFrame, expected_share: float = 0.5, tolerance: float = 0.02) -> DataFrame:
    """D from ``(variant, n)``."""
    # SUM(COUNT(*)) OVER (): a window over one row per variant
    g = g.withColumn("total", F.sum("n").over(Window.partitionBy()))
    n, t = F.col("n"), F.col("total")
    off = F.abs(n - F.lit(Decimal(str(expected_share))) * t) > F.lit(Decimal(str(tolerance))) * t
    return g.select(
        "variant",
        n.cast("long").alias("n_enrolled"),
        C.pct("n", "total", 2).alias("pct_of_total"),
        F.when(off, F.lit(L.SRM_LABELS[0])).otherwise(F.lit(L.SRM_LABELS[1])).alias("srm_status"))


def cancellation_guardrail(cohort: DataFrame, orders: DataFrame, days: int = 60) -> DataFrame:
    """E: orders (any status) and cancellations within ``days`` of enrollment, per variant.

    Takes the cohort, or results, whose rows are the cohort's.
    """
    enrolled = cohort.select("account_id", "variant", "enrollment_date")
    daily = cohort_orders(orders, enrolled, days).groupBy("account_id", C.day("placed_at").alias("order_day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("order_status") == "cancelled").alias("cancelled"))
    offset = F.datediff(F.col("order_day"), F.col("enrollment_date"))
    g = enrolled.join(daily, "account_id") \
        .filter((offset >= 0) & (offset <= days)).groupBy("variant").agg(
            F.sum("n").alias("n"), F.sum("cancelled").alias("cancelled"))
    return g.select(
        "variant",
        F.col("n").cast("long").alias("total_orders"),
        F.col("cancelled").cast("long").alias("cancellations"),
        C.pct("cancelled", "n", 2).alias("cancellation_rate_pct"),
    ).orderBy("variant")


#: The groupings of the read-out: all accounts of a variant, and its cuts.
SEGMENTS = ("account_tier", "account_age_segment", "user_segment")


def read_out(results: DataFrame, orders: DataFrame, launch: str | dt.date = "2024-03-01", lookback_days: int = 90,
             min_orders: int = 4) -> DataFrame:
    """Every grouping of the reports from one pass over the result: grouping sets over (variant) and (segment, variant).

    ``cut`` names the segment column (null for the variant alone), ``segment``
    its value; then the measures.  A row for each segment and variant, so the
    reports made of it cost nothing more.
    """
    cut = with_power_users(results, orders, launch, lookback_days, min_orders).withColumn("account_age_segment", age_segment())
    sets = [[F.col("variant")], *[[F.col(c), F.col("variant")] for c in SEGMENTS]]
    g = cut.groupingSets(sets, *SEGMENTS, "variant").agg(
        *[F.grouping(c).alias(f"_{c}") for c in SEGMENTS],
        *_measures("n", "conv", "sd_conv", "fov", "gmv", "sd_gmv", "pre_sum", "pre_n"))
    pick = lambda of: F.coalesce(*[F.when(F.col(f"_{c}") == 0, of(c)) for c in SEGMENTS])
    return g.select(pick(F.lit).alias("cut"), pick(F.col).alias("segment"), "variant",
                    "n", "conv", "sd_conv", "fov", "gmv", "sd_gmv", "pre_sum", "pre_n")


def read_out_report(groups: DataFrame) -> DataFrame:
    """The read-out as one table: accounts, conversions, rate and mean GMV for each cut, segment and variant."""
    return groups.select(
        F.coalesce("cut", F.lit("variant")).alias("cut"), "segment", "variant", F.col("n").cast("long").alias("n_accounts"),
        F.col("conv").cast("long").alias("conversions"), C.pct("conv", "n", 2).alias("conversion_rate_pct"),
        C.ratio(C.cents("gmv"), F.col("n") * 100, 2).alias("avg_gmv_60d"))


def report_suite(assignments: DataFrame, accounts: DataFrame, orders: DataFrame, experiment: str = "SPRING20",
                 conv_days: int = 30, gmv_days: int = 60, launch: str | dt.date = "2024-03-01",
                 lookback_days: int = 90, min_orders: int = 4, guardrail_days: int = 60) -> dict[str, DataFrame]:
    """The whole experiment read-out on one materialised result.

    The per-account result is written once (reliable checkpoint).  One pass
    over it makes all groupings (:func:`read_out`); the sample-ratio check,
    metrics and segment cuts are projections of those few rows.  Only the exact
    median and the guardrail read the result again.  The order is the one the
    analysis is meant to be read in (SRM first).
    """
    results = persist_results(experiment_results(assignments, accounts, orders, experiment, conv_days, gmv_days))
    groups = materialize(read_out(results, orders, launch, lookback_days, min_orders))
    variants = groups.filter("cut IS NULL")
    of = lambda c: groups.filter(F.col("cut") == c).withColumnRenamed("segment", c)
    return {
        "srm_check": srm_of(variants),
        "conversion_by_variant": conversion_of(variants),
        "gmv_by_variant": gmv_of(variants.join(ranking.middle_values(results, ["variant"], "gmv_60d"), "variant", "left")),
        "results_by_tier": tiers_of(of("account_tier")),
        "power_users": power_of(of("user_segment")),
        "account_age": ages_of(of("account_age_segment")),
        "cancellation_guardrail": cancellation_guardrail(results, orders, guardrail_days),
        "results": results_report(results),
    }
