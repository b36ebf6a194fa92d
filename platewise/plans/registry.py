"""The reports, and the registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

``dq_table_rules``, all single-row rules in one scan per table).
``QUERIES`` read the driver's test tables (mapped by the adapter);
``queries("canonical")`` read a layout written by ``sources.write_canonical``.  Parameters that the
reference hard-codes for 2024 data come from ``params`` (chosen for the
1995-2001 test data); everything else uses the library defaults, which keep
the reference's values.  Each query reads whole tables: no sampling, no caps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import sources
from ..operators import caterer, experiment, ltv, promo, quality, retention, revenue
from . import params as P
from . import stored

Query = Callable[[SparkSession, str], DataFrame]
Report = Callable[[sources.Marketplace], DataFrame]


def q1a_caterer_scorecard(m):
    return caterer.caterer_scorecard(m.caterers, m.orders)


def q1b_monthly_otd_trend(m):
    return caterer.monthly_otd_trend(m.caterers, m.orders)


def q1c_caterer_tier(m):
    return caterer.caterer_tier(m.caterers, m.orders)


def q2a_monthly_gmv_growth(m):
    return revenue.monthly_gmv_growth(m.orders)


def q2b_revenue_pareto(m):
    return revenue.revenue_pareto(m.corporate_accounts, m.orders)


def q2c_gmv_by_tier_quarter(m):
    return revenue.gmv_by_tier_quarter(m.corporate_accounts, m.orders)


def q3a_order_cadence(m):
    return retention.order_cadence(m.corporate_accounts, m.orders, P.ANALYSIS_DATE)


def q3b_cohort_retention(m):
    return retention.cohort_retention(m.orders)


def q3c_churn_risk(m):
    return retention.churn_risk(m.corporate_accounts, m.orders, P.ANALYSIS_DATE)


def q4a_promo_vs_nonpromo(m):
    return promo.promo_vs_nonpromo(m.corporate_accounts, m.orders, m.promo_orders)


def q4b_campaign_roi(m):
    return promo.campaign_roi(m.promotions, m.promo_orders, m.orders)


def q4c_first_order_promo(m):
    return promo.first_order_promo(m.orders, m.promo_orders)


def q5a1_experiment_enrollment(m):
    return experiment.experiment_enrollment(m.experiment_assignments, m.corporate_accounts, P.EXPERIMENT,
                                            P.ENROLL_START, P.ENROLL_END)


def _results(m: sources.Marketplace) -> DataFrame:
    return experiment.experiment_results(m.experiment_assignments, m.corporate_accounts, m.orders,
                                         P.EXPERIMENT, P.CONV_DAYS, P.GMV_DAYS)


def _cohort(m: sources.Marketplace) -> DataFrame:
    return experiment.persist_results(
        experiment.experiment_cohort(m.experiment_assignments, m.corporate_accounts, P.EXPERIMENT))


def q5a2_experiment_results(m):
    return experiment.results_report(_results(m))


def q5b1_conversion_by_variant(m):
    return experiment.conversion_by_variant(_results(m))


def q5b2_gmv_by_variant(m):
    return experiment.gmv_by_variant(experiment.persist_results(_results(m)))


def q5c1_results_by_tier(m):
    return experiment.results_by_tier(_results(m))


def q5c2_power_users(m):
    return experiment.power_users(_results(m), m.orders, P.LAUNCH, P.LOOKBACK_DAYS, P.MIN_PRE_ORDERS)


def q5c3_account_age(m):
    return experiment.account_age(_results(m))


def q5d_srm_check(m):
    return experiment.srm_check(experiment.experiment_cohort(m.experiment_assignments, m.corporate_accounts, P.EXPERIMENT))


def q5e_cancellation_guardrail(m):
    return experiment.cancellation_guardrail(_cohort(m), m.orders, P.GMV_DAYS)


def experiment_read_out(m):
    return experiment.read_out_report(experiment.read_out(_results(m), m.orders, P.LAUNCH, P.LOOKBACK_DAYS, P.MIN_PRE_ORDERS))


def q6a_signup_funnel(m):
    return ltv.signup_funnel(m.corporate_accounts, m.orders)


def q6b_ltv_by_cohort(m):
    return ltv.ltv_by_cohort(m.corporate_accounts, m.orders)


def q6c_top_accounts_churn(m):
    return ltv.top_accounts_churn(m.corporate_accounts, m.orders, P.ANALYSIS_DATE)


def _dq(check):
    return lambda m: check(m.as_dict())


def dq_status_timestamps(m):
    return quality.status_timestamp_check(m.orders)


REPORTS: dict[str, Report] = {
    "q1a_caterer_scorecard": q1a_caterer_scorecard,
    "q1b_monthly_otd_trend": q1b_monthly_otd_trend,
    "q1c_caterer_tier": q1c_caterer_tier,
    "q2a_monthly_gmv_growth": q2a_monthly_gmv_growth,
    "q2b_revenue_pareto": q2b_revenue_pareto,
    "q2c_gmv_by_tier_quarter": q2c_gmv_by_tier_quarter,
    "q3a_order_cadence": q3a_order_cadence,
    "q3b_cohort_retention": q3b_cohort_retention,
    "q3c_churn_risk": q3c_churn_risk,
    "q4a_promo_vs_nonpromo": q4a_promo_vs_nonpromo,
    "q4b_campaign_roi": q4b_campaign_roi,
    "q4c_first_order_promo": q4c_first_order_promo,
    "q5a1_experiment_enrollment": q5a1_experiment_enrollment,
    "q5a2_experiment_results": q5a2_experiment_results,
    "q5b1_conversion_by_variant": q5b1_conversion_by_variant,
    "q5b2_gmv_by_variant": q5b2_gmv_by_variant,
    "q5c1_results_by_tier": q5c1_results_by_tier,
    "q5c2_power_users": q5c2_power_users,
    "q5c3_account_age": q5c3_account_age,
    "q5d_srm_check": q5d_srm_check,
    "q5e_cancellation_guardrail": q5e_cancellation_guardrail,
    "experiment_read_out": experiment_read_out,
    "q6a_signup_funnel": q6a_signup_funnel,
    "q6b_ltv_by_cohort": q6b_ltv_by_cohort,
    "q6c_top_accounts_churn": q6c_top_accounts_churn,
    "dq_not_null": _dq(quality.not_null_check),
    "dq_unique_key": _dq(quality.unique_key_check),
    "dq_foreign_key": _dq(quality.foreign_key_check),
    "dq_domain": _dq(quality.domain_check),
    "dq_range": _dq(quality.range_check),
    "dq_length": _dq(quality.length_check),
    "dq_default_fill": _dq(quality.default_fill_check),
    "dq_status_timestamps": dq_status_timestamps,
    "dq_table_rules": _dq(quality.table_rules_check),
}


def queries(layout: str = "test") -> dict[str, Query]:
    """Every report as a query over the tables of ``layout`` under a path (see ``sources.load``)."""
    def bound(report: Report) -> Query:
        return lambda spark, path: report(sources.load(spark, path, layout))
    return {key: bound(report) for key, report in REPORTS.items()}


#: The reports over the test tables, and the queries over tables that are stored from them first.
QUERIES: dict[str, Query] = queries() | stored.QUERIES
