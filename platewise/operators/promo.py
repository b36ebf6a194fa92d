"""Promotion analytics: promo vs non-promo orders, campaign ROI, first-order attribution."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import labels as L


def promo_vs_nonpromo(accounts: DataFrame, orders: DataFrame, promo_orders: DataFrame,
                      dedupe: bool = False) -> DataFrame:
    """Tier x (Promo | Non-Promo): delivered orders, order value, discount, headcount.

    As in the source, an order linked to k promotions counts k times (the
    left join fans out) and a discounted order without a link is Non-Promo;
    ``dedupe=True`` counts every order once.  Totals per account come from all
    delivered orders; the links meet only the orders that have one (an inner
    join, so the link keys can prune the fact), and Non-Promo is the totals
    less the linked orders.  Only those roll-ups meet the accounts table.
    """
    links = promo_orders.groupBy("order_id").agg(F.count(F.lit(1)).alias("links"))
    delivered = orders.filter(F.col("order_status") == "delivered") \
        .select("order_id", "account_id", "order_total_usd", "discount_usd", "headcount")

    def sums(prefix: str, w) -> list:
        return [F.sum(w).alias(f"{prefix}n"), F.sum(F.col("order_total_usd") * w).alias(f"{prefix}total"),
                F.sum(F.col("discount_usd") * w).alias(f"{prefix}disc"), F.sum(F.col("headcount") * w).alias(f"{prefix}heads"),
                F.sum(F.when(F.col("headcount").isNotNull(), w)).alias(f"{prefix}heads_n")]
    one = F.lit(1).cast("long")
    every = delivered.groupBy("account_id").agg(*sums("a_", one))
    linked = delivered.join(links, "order_id").groupBy("account_id").agg(
        *sums("p_", one if dedupe else F.col("links")), *sums("l_", one))
    names = ["n", "total", "disc", "heads", "heads_n"]
    less = lambda c: F.coalesce(F.col(f"a_{c}"), F.lit(0)) - F.coalesce(F.col(f"l_{c}"), F.lit(0))
    sides = [F.struct(F.lit(L.PROMO).alias("order_type"), *[F.col(f"p_{c}").alias(c) for c in names]),
             F.struct(F.lit(L.NON_PROMO).alias("order_type"), *[less(c).alias(c) for c in names])]
    cast = [F.struct(s["order_type"].alias("order_type"), *[
        s[c].cast("long" if c in ("n", "heads", "heads_n") else "decimal(38,2)").alias(c) for c in names]) for s in sides]
    per_account = (every.join(linked, "account_id", "left").select("account_id", F.explode(F.array(*cast)).alias("s"))
                   .select("account_id", "s.*").filter("n > 0"))
    g = per_account.join(accounts.select("account_id", "account_tier"), "account_id") \
        .groupBy("account_tier", "order_type").agg(
            F.sum("n").alias("n"), F.sum("total").alias("total"),
            F.sum("disc").alias("disc"), F.sum("heads").alias("heads"), F.sum("heads_n").alias("heads_n"))
    n100 = F.col("n") * 100
    return g.select(
        "account_tier", "order_type",
        F.col("n").cast("long").alias("order_count"),
        C.ratio(C.cents("total"), n100, 2).alias("avg_order_value_usd"),
        C.ratio(C.cents("disc"), n100, 2).alias("avg_discount_usd"),
        C.ratio(C.cents("total") - C.cents("disc"), n100, 2).alias("avg_net_revenue_usd"),
        C.ratio("heads", "heads_n", 1).alias("avg_headcount"),
        C.pct(C.cents("disc"), C.cents("total"), 2).alias("discount_rate_pct"),
    ).orderBy(C.tier_rank("account_tier"), "order_type")


def campaign_roi(promotions: DataFrame, promo_orders: DataFrame, orders: DataFrame,
                 roi_threshold: int | float | Decimal = 5) -> DataFrame:
    """Per promotion: linked orders, gross / discount / net GMV of the delivered ones, ROI flag.

    ``orders_with_promo`` counts every link (the status filter sits in the join
    condition), the sums only delivered orders.  The flag compares the
    unrounded GMV per discount dollar with the threshold, exactly.
    """
    delivered = orders.filter(F.col("order_status") == "delivered").select(
        "order_id", "order_total_usd", "discount_usd")
    per_promo = promo_orders.join(delivered, "order_id", "left").groupBy("promo_id").agg(
        F.count("order_id").alias("links"),
        F.sum("order_total_usd").alias("gross"),
        F.sum("discount_usd").alias("disc"))
    gross, disc = F.col("gross"), F.col("disc")
    k = F.lit(Decimal(str(roi_threshold)))
    meets = F.when(disc > 0, gross >= k * disc).when(disc < 0, gross <= k * disc)
    flag = F.when(meets, F.lit(L.ROI_LABELS[0])).when(disc == 0, F.lit(L.ROI_LABELS[1])).otherwise(F.lit(L.ROI_LABELS[2]))
    return promotions.join(per_promo, "promo_id", "left").select(
        "promo_code", "description", "discount_type", "target_tier", "start_date", "end_date",
        F.coalesce(F.col("links"), F.lit(0)).cast("long").alias("orders_with_promo"),
        C.money(gross).alias("gross_gmv_usd"),
        C.money(disc).alias("total_discount_cost_usd"),
        C.money(gross - disc).alias("net_gmv_usd"),
        C.ratio(C.cents(gross), C.cents(disc), 2).alias("gmv_per_discount_dollar"),
        flag.alias("roi_assessment"), "promo_id",
    ).orderBy(F.col("net_gmv_usd").desc_nulls_last(), "promo_id").drop("promo_id")


def first_order_promo(orders: DataFrame, promo_orders: DataFrame, strict: bool = False) -> DataFrame:
    """Lifetime delivered orders / GMV of accounts whose first order had a promo vs not.

    First orders are every order (any status) placed at the account's first
    non-cancelled timestamp, fanned out by promo links, as written.  With
    ``strict=True`` each account has exactly one first order, the earliest
    non-cancelled one by (placed_at, order_id), flagged if it has any link.
    ``promo_ltv_lift_usd`` is the real lift (promo mean minus organic mean,
    exact, on both rows); ``promo_ltv_lift_as_written`` keeps the source's
    expression, which filters inside its own group and is always NULL.

    Orders are rolled up per (account, timestamp) and then per account without
    their links; the links meet only the orders that have one (an inner join),
    of which those at the first timestamp count.  The fan-out becomes a row
    weight (promo rows and organic rows per account).
    """
    links = promo_orders.groupBy("order_id").agg(F.count(F.lit(1)).alias("links"))
    live = F.col("order_status") != "cancelled"
    delivered = F.col("order_status") == "delivered"
    rows = orders.select("order_id", "account_id", "placed_at", "order_status", "order_total_usd")
    per_ts = rows.groupBy("account_id", "placed_at").agg(
        F.count_if(live).alias("live"), F.count(F.lit(1)).alias("placed"),
        F.min(F.when(live, F.col("order_id"))).alias("first_live"),
        F.count_if(delivered).alias("d_n"),
        F.sum(F.when(delivered, F.col("order_total_usd"))).alias("d_gmv"))
    totals = per_ts.groupBy("account_id").agg(
        F.min(F.when(F.col("live") > 0, F.struct("placed_at", "placed", "first_live"))).alias("first"),
        F.sum("d_n").alias("lifetime_orders"), F.sum("d_gmv").alias("lifetime_gmv"))
    linked = rows.join(links, "order_id").groupBy(F.col("account_id").alias("l_account"), F.col("placed_at").alias("l_ts")).agg(
        F.sum("links").alias("promo_rows"), F.count(F.lit(1)).alias("linked"), F.min(F.when(live, F.col("order_id"))).alias("l_first"))
    per_account = totals.join(
        linked, (totals["account_id"] == linked["l_account"]) & (F.col("first.placed_at") == linked["l_ts"]), "left")
    if strict:
        had = F.coalesce(F.col("l_first") == F.col("first.first_live"), F.lit(False))
        weights = [(F.lit(True), F.when(had, 1).otherwise(0)), (F.lit(False), F.when(had, 0).otherwise(1))]
    else:
        weights = [(F.lit(True), F.coalesce("promo_rows", F.lit(0))),
                   (F.lit(False), F.col("first.placed") - F.coalesce("linked", F.lit(0)))]
    # accounts without a delivered order drop out (inner join to their LTV), as do
    # accounts without a non-cancelled order (no first order)
    rows = per_account.filter((F.col("lifetime_orders") > 0) & F.col("first").isNotNull()).select(
        "lifetime_orders", "lifetime_gmv",
        F.explode(F.array(*[F.struct(flag.alias("first_order_had_promo"), w.cast("long").alias("w"))
                            for flag, w in weights])).alias("e")) \
        .select("e.first_order_had_promo", "e.w", "lifetime_orders", "lifetime_gmv").filter(F.col("w") > 0)
    flag, gmv, w = F.col("first_order_had_promo"), F.col("lifetime_gmv"), F.col("w")
    # the source's FILTERed averages inside one flag group: one side is always empty
    side_avg = lambda cond: F.try_divide(F.sum(F.when(cond, gmv * w)), F.sum(F.when(cond, w)))
    g = rows.groupBy("first_order_had_promo").agg(
        F.sum(w).alias("accounts"),
        F.sum(F.col("lifetime_orders") * w).alias("orders_sum"),
        F.sum(gmv * w).alias("gmv_sum"),
        (side_avg(flag) - side_avg(~flag)).alias("lift_as_written"))
    # both group means as exact fractions, spread to the two rows by a window
    # over the grouped result itself (two rows), so the input is read once
    both = Window.partitionBy()
    p_sum = F.max(F.when(flag, F.col("gmv_sum"))).over(both)
    p_n = F.max(F.when(flag, F.col("accounts"))).over(both).cast("decimal(38,0)")
    o_sum = F.max(F.when(~flag, F.col("gmv_sum"))).over(both)
    o_n = F.max(F.when(~flag, F.col("accounts"))).over(both).cast("decimal(38,0)")
    lift_num = C.cents(p_sum) * o_n - C.cents(o_sum) * p_n
    lift_den = p_n * o_n * 100
    return g.select(
        "first_order_had_promo",
        F.col("accounts").cast("long").alias("accounts"),
        C.ratio("orders_sum", "accounts", 1).alias("avg_lifetime_orders"),
        C.ratio(C.cents("gmv_sum"), F.col("accounts") * 100, 2).alias("avg_lifetime_gmv_usd"),
        C.ratio(lift_num, lift_den, 2).alias("promo_ltv_lift_usd"),
        C.rounded(F.col("lift_as_written").cast("double"), 2).alias("promo_ltv_lift_as_written"),
    ).orderBy(F.col("first_order_had_promo").desc_nulls_first())
