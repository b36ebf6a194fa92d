"""Invariants of the analytics on the driver's sf0.001 tables."""

from pyspark.sql import functions as F

from platewise.plans import registry
from tests.conftest import SF_SMALL


def q(spark, key):
    return registry.QUERIES[key](spark, SF_SMALL)


def test_pareto_shares_sum_to_100(spark):
    total = q(spark, "q2b_revenue_pareto").agg(F.sum("gmv_share_pct")).first()[0]
    assert abs(total - 100) < 0.01 * 20


def test_cohort_period_zero_is_100(spark):
    assert {r.retention_pct for r in q(spark, "q3b_cohort_retention").filter("period_number = 0").collect()} == {100.0}


def test_ltv_horizons_are_monotone(spark):
    for r in q(spark, "q6b_ltv_by_cohort").collect():
        assert r.avg_ltv_30d <= r.avg_ltv_90d <= r.avg_ltv_180d <= r.avg_ltv_lifetime


def test_quartiles_differ_by_at_most_one(spark):
    sizes = [r["count"] for r in q(spark, "q1c_caterer_tier").groupBy("performance_tier").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_srm_shares_sum_to_100(spark):
    assert abs(q(spark, "q5d_srm_check").agg(F.sum("pct_of_total")).first()[0] - 100) < 0.02


def test_results_one_row_per_account(spark):
    df = q(spark, "q5a2_experiment_results")
    assert df.count() == df.select("account_id").distinct().count()


def test_promo_split_covers_delivered_orders(spark):
    delivered = registry.sources.load(spark, SF_SMALL, "test").orders.filter("order_status = 'delivered'").count()
    assert q(spark, "q4a_promo_vs_nonpromo").agg(F.sum("order_count")).first()[0] >= delivered
