"""Adapter from the driver's TPC-H-style test tables to the canonical schema.

The column expressions are kept as SQL text; the oracle's views use the same
fixed mapping rules, but join the raw tables themselves.  No row of a raw table
is left out: an order without line items has no caterer and no headcount.

Nation (25 rows) and region (5 rows) are fixed-size TPC-H dimensions, so they
are the only tables broadcast explicitly here; every other join is left to the
planner, which converts to a broadcast at runtime only below its measured size
threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The mapping rules of the test fixtures, as SQL expressions.
ACCOUNT_COLUMNS = [
    "c_custkey AS account_id",
    "c_name AS company_name",
    "c_mktsegment AS industry",
    "CASE WHEN c_acctbal < 2000 THEN 'smb' WHEN c_acctbal < 6000 THEN 'mid_market' ELSE 'enterprise' END AS account_tier",
    "n_name AS city",
    "UPPER(SUBSTR(r_name, 1, 2)) AS state_code",
    "DATE '1995-01-01' + CAST((c_custkey % 49) * 30 AS INT) AS created_at",
    "c_custkey % 20 <> 0 AS is_active",
]
CATERER_COLUMNS = [
    "s_suppkey AS caterer_id",
    "s_name AS caterer_name",
    "n_name AS city",
    "UPPER(SUBSTR(r_name, 1, 2)) AS state_code",
    "r_name AS cuisine_type",
    "CASE WHEN s_suppkey % 33 = 5 THEN NULL ELSE CAST(ROUND(1 + 4*(s_acctbal+1000)/11000, 2) AS DECIMAL(3,2)) END AS avg_rating",
    "CAST(s_suppkey * 37 % 500 AS INT) AS total_reviews",
    "DATE '1994-01-01' + CAST(s_suppkey % 300 AS INT) AS onboarded_at",
    "s_suppkey % 20 <> 0 AS is_active",
]
ORDER_COLUMNS = [
    "o_orderkey AS order_id",
    "CASE WHEN o_custkey % 25 = 24 THEN o_custkey - 1 ELSE o_custkey END AS account_id",
    "CASE WHEN m % 10 = 7 THEN m - 1 ELSE m END AS caterer_id",
    "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'in_transit' ELSE 'cancelled' END AS order_status",
    "CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'express' WHEN o_orderpriority = '5-LOW' THEN 'scheduled' ELSE 'standard' END AS delivery_tier",
    "CAST(q AS INT) AS headcount",
    "CAST(o_totalprice AS DECIMAL(10,2)) AS order_total_usd",
    "CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 15 END AS DECIMAL(8,2)) AS delivery_fee_usd",
    "CAST(CASE WHEN o_orderkey % 4 = 0 THEN ROUND(CAST(o_totalprice AS DECIMAL(10,2)) * 0.15, 2) ELSE 0 END AS DECIMAL(10,2)) AS discount_usd",
    "o_orderdate AS placed_at",
    "o_orderdate + INTERVAL '3' HOUR AS scheduled_delivery",
    "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 50 <> 0 THEN o_orderdate + INTERVAL '3' HOUR + (CAST(o_orderkey % 61 AS INT) - 30) * INTERVAL '1' MINUTE END AS actual_delivery",
    "CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL '2' HOUR END AS cancelled_at",
]
PROMOTION_FILTER = "p_type = 'PROMO'"
PROMOTION_COLUMNS = [
    "p_partkey AS promo_id",
    "UPPER(p_name) || '-' || CAST(p_partkey AS VARCHAR(20)) AS promo_code",
    "p_type AS description",
    "CASE p_size % 3 WHEN 0 THEN 'flat' WHEN 1 THEN 'percent' ELSE 'free_delivery' END AS discount_type",
    "CAST(p_size AS DECIMAL(8,2)) AS discount_value",
    "DATE '1995-01-01' AS start_date",
    "DATE '2001-12-31' AS end_date",
    "CASE p_size % 4 WHEN 0 THEN 'smb' WHEN 1 THEN 'mid_market' WHEN 2 THEN 'enterprise' END AS target_tier",
]
PROMO_LINK_COLUMNS = ["l_partkey AS promo_id", "l_orderkey AS order_id"]
ITEM_COLUMNS = [
    "l_orderkey AS order_id",
    "l_linenumber AS line_number",
    "p_name AS item_name",
    "p_type AS category",
    "CAST(l_extendedprice AS DECIMAL(10,2)) AS unit_price_usd",
    "CAST(l_quantity AS INT) AS quantity",
]
EVENT_COLUMNS = [
    "event_id",
    "user_id AS order_id",
    "CASE event_type WHEN 'signup' THEN 'dispatched' WHEN 'view' THEN 'arrived' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END AS event_type",
    "ts AS event_ts",
    "props AS notes",
]
ASSIGNMENT_FILTER = "event_type = 'signup'"
ASSIGNMENT_COLUMNS = [
    "event_id AS assignment_id",
    "user_id AS account_id",
    "'SPRING20' AS experiment_name",
    "CASE WHEN event_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant",
    "ts - INTERVAL '9131' DAY AS assigned_at",
]

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _raw(spark, sf_dir, "nation")
    region = _raw(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_name")


def load_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Canonical tables as lazy DataFrames over the driver's parquet files."""
    raw = lambda name: _raw(spark, sf_dir, name)
    geo = F.broadcast(_geo(spark, sf_dir))

    customer = raw("customer")
    accounts = customer.join(geo, customer.c_nationkey == geo.n_nationkey).selectExpr(*ACCOUNT_COLUMNS)

    supplier = raw("supplier")
    caterers = supplier.join(geo, supplier.s_nationkey == geo.n_nationkey).selectExpr(*CATERER_COLUMNS)

    lineitem = raw("lineitem")
    # Orders take caterer and headcount from their line items: one partial +
    # final aggregate on l_orderkey, whose output partitioning the join reuses.
    # An order without line items stays, with both NULL.
    rollup = lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("m"), F.sum("l_quantity").alias("q"))
    o = raw("orders")
    orders = o.join(rollup, o.o_orderkey == rollup.l_orderkey, "left").selectExpr(*ORDER_COLUMNS)

    part = raw("part")
    promotions = part.filter(PROMOTION_FILTER).selectExpr(*PROMOTION_COLUMNS)
    promo_orders = (lineitem.select("l_partkey", "l_orderkey")
                    .join(part.filter(PROMOTION_FILTER).select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
                    .selectExpr(*PROMO_LINK_COLUMNS)
                    .dropDuplicates(["promo_id", "order_id"]))
    items = lineitem.join(part, lineitem.l_partkey == part.p_partkey).selectExpr(*ITEM_COLUMNS)

    events = raw("events")
    delivery_events = events.selectExpr(*EVENT_COLUMNS)
    assignments = events.filter(ASSIGNMENT_FILTER).selectExpr(*ASSIGNMENT_COLUMNS)

    return {
        "corporate_accounts": accounts,
        "caterers": caterers,
        "orders": orders,
        "order_items": items,
        "delivery_events": delivery_events,
        "promotions": promotions,
        "promo_orders": promo_orders,
        "experiment_assignments": assignments,
    }
