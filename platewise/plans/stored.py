"""Registered queries over stored tables: built once for an application and path, below the checkpoint folder.

The test tables' orders come in three batches (by order number, so that every
period is touched by each of them), and the second batch comes twice.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..operators import rollup, sketches
from ..session import ensure_checkpoint_dir
from ..sources import ingest, schemas
from . import params as P

_BUILT: dict[tuple, str] = {}

#: Batches in the order they arrive: three parts of the orders, one of them again.
ARRIVALS = (0, 1, 2, 1)
#: The test tables have a few orders a day, so a partition there is a year.
UNIT = "year"
#: Buckets by account of the test tables.
BUCKETS = 8


def built(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    """Folder of a stored table over the tables in ``sf_dir``; ``build(path)`` writes it the first time."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{key[0]}/{name}-{uuid.uuid4().hex}"
        build(path)
        _BUILT[key] = path
    return _BUILT[key]


def rollup_store(spark: SparkSession, sf_dir: str) -> str:
    def build(path: str) -> None:
        orders = sources.load(spark, sf_dir, "test").orders
        for arrival, part in enumerate(ARRIVALS):
            rollup.apply_batch(spark, path, orders.filter(F.col("order_id") % 3 == part), arrival, UNIT)
    return built(spark, sf_dir, "rollup", build)


def _days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    accounts = sources.load(spark, sf_dir, "test").corporate_accounts
    return accounts, rollup.read_days(spark, rollup_store(spark, sf_dir))


def rollup_monthly_gmv_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.monthly_gmv_growth(_days(spark, sf_dir)[1])


def rollup_gmv_by_tier_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.gmv_by_tier_quarter(*_days(spark, sf_dir))


def rollup_order_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.order_cadence(*_days(spark, sf_dir), P.ANALYSIS_DATE)


def rollup_cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.cohort_retention(_days(spark, sf_dir)[1])


def rollup_churn_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.churn_risk(*_days(spark, sf_dir), P.ANALYSIS_DATE)


def rollup_ltv_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.ltv_by_cohort(*_days(spark, sf_dir))


def _bucketed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = built(spark, sf_dir, "bucketed", lambda path: rollup.write_bucketed(*_days(spark, sf_dir), path, BUCKETS))
    return rollup.read_bucketed(spark, path)


def bucketed_churn_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.churn_risk(*_bucketed(spark, sf_dir), P.ANALYSIS_DATE)


def bucketed_ltv_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.ltv_by_cohort(*_bucketed(spark, sf_dir))


def bucketed_top_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.top_accounts_churn(*_bucketed(spark, sf_dir), P.ANALYSIS_DATE)


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    def build(path: str) -> None:
        for name, df in sources.load(spark, sf_dir, "test").as_dict().items():
            ingest.ingest(df, name, path, "0")
    return built(spark, sf_dir, "ingest", build)


def dq_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table the rows that ingest took in and kept out."""
    path = _ingested(spark, sf_dir)
    parts = [side(spark, path, t).select(F.lit(t).alias("table_name"), F.lit(ok).alias("ok")) for t in schemas.SCHEMAS
             for side, ok in ((ingest.accepted, True), (ingest.quarantine, False))]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("table_name").agg(
        F.count_if("ok").cast("long").alias("n_accepted"), F.count_if(~F.col("ok")).cast("long").alias("n_rejected"))


def dq_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule the rows in quarantine that break it, and those that break it alone."""
    return ingest.quarantine_report(spark, _ingested(spark, sf_dir), list(schemas.SCHEMAS))


GRAINS = ("month", "quarter", "year", "lifetime")


def sketch_active_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct accounts per tier at four grains from monthly sketches, held against the exact counts."""
    m = sources.load(spark, sf_dir, "test")
    path = built(spark, sf_dir, "sketches", lambda path: sketches.active_accounts_sketches(m.corporate_accounts, m.orders).write.parquet(path))
    stored = spark.read.parquet(path)
    estimates = functools.reduce(DataFrame.unionByName, [
        sketches.active_accounts(stored, g).withColumn("grain", F.lit(g)) for g in GRAINS])
    days = rollup.read_days(spark, rollup_store(spark, sf_dir)).filter("n_delivered > 0").select("account_id", "order_day")
    tiers = m.corporate_accounts.select("account_id", "account_tier")
    period = lambda g: F.lit(None).cast("date") if g == "lifetime" else F.trunc("order_day", g)
    grains = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), period(g).alias("period")) for g in GRAINS])).alias("at")
    exact = days.join(tiers, "account_id").select("account_id", "account_tier", grains).select("account_id", "account_tier", "at.*").distinct() \
        .groupBy("account_tier", "grain", "period").agg(F.count(F.lit(1)).alias("accounts"))
    e = estimates.withColumnsRenamed({"account_tier": "_tier", "grain": "_grain", "period": "_period"})
    met = exact.join(e, (F.col("account_tier") == F.col("_tier")) & (F.col("grain") == F.col("_grain"))
                     & F.col("period").eqNullSafe(F.col("_period")), "full_outer")
    bound = F.abs(F.col("active_accounts") - F.col("accounts")) <= F.col("accounts") * sketches.hll_error()
    return met.select("account_tier", "grain", "period", F.col("accounts").cast("long").alias("accounts"), bound.alias("within_bound"))


def sketch_order_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of order values per tier, merged from sketches by cohort and month: is their rank within the bound?"""
    m = sources.load(spark, sf_dir, "test")
    path = built(spark, sf_dir, "quantiles", lambda path: sketches.order_value_sketches(m.corporate_accounts, m.orders).write.parquet(path))
    quantiles = (0.25, 0.5, 0.75, 0.9)
    found = sketches.order_value_quantiles(spark.read.parquet(path), ["account_tier"], quantiles)
    found = found.select("account_tier", "n", F.explode(F.array(*[
        F.struct(F.lit(q).alias("quantile"), F.col(f"p{round(100 * q)}").alias("value")) for q in quantiles])).alias("at")) \
        .select("account_tier", "n", "at.quantile", "at.value")
    paid = m.orders.filter("order_status = 'delivered'").join(m.corporate_accounts.select("account_id", "account_tier"), "account_id") \
        .select("account_tier", F.col("order_total_usd").cast("double").alias("paid"))
    ranks = paid.join(found, "account_tier").groupBy("account_tier", "quantile", "n").agg(
        F.count_if(F.col("paid") < F.col("value")).alias("below"), F.count_if(F.col("paid") <= F.col("value")).alias("through"))
    slack = F.col("n") * sketches.kll_error()
    within = (F.col("below") <= F.col("n") * F.col("quantile") + slack) & (F.col("through") >= F.col("n") * F.col("quantile") - slack)
    return ranks.select("account_tier", "quantile", F.col("n").cast("long").alias("n"), within.alias("within_bound"))


QUERIES = {f.__name__: f for f in (
    rollup_monthly_gmv_growth, rollup_gmv_by_tier_quarter, rollup_order_cadence, rollup_cohort_retention, rollup_churn_risk,
    rollup_ltv_by_cohort, bucketed_churn_risk, bucketed_ltv_by_cohort, bucketed_top_accounts, dq_ingest, dq_quarantine,
    sketch_active_accounts, sketch_order_values)}
