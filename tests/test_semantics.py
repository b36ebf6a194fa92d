"""Micro fixtures in the canonical schema with hand-worked answers for the semantic traps."""

from datetime import date
from datetime import datetime as ts
from decimal import Decimal as D

import pytest

from platewise.operators import caterer, experiment, ltv, promo, quality, retention, revenue
from platewise.sources import schemas as S

ORDER_DEFAULTS = dict(account_id=1, caterer_id=1, order_status="delivered", delivery_tier="standard", headcount=10,
                      order_total_usd=D("100.00"), delivery_fee_usd=D("0.00"), discount_usd=D("0.00"),
                      placed_at=ts(2024, 1, 1, 12), scheduled_delivery=ts(2024, 1, 2, 12),
                      actual_delivery=ts(2024, 1, 2, 12), cancelled_at=None)


def make(spark, schema, rows, defaults=None):
    defaults = defaults or {}
    full = [tuple({**defaults, **r}.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(full, schema)


def orders(spark, *rows):
    return make(spark, S.ORDERS, [dict(order_id=i + 1, **r) for i, r in enumerate(rows)], ORDER_DEFAULTS)


def accounts(spark, *rows):
    base = dict(company_name="Co", industry="Tech", account_tier="smb", city="X", state_code="XX",
                created_at=date(2023, 1, 1), is_active=True)
    return make(spark, S.CORPORATE_ACCOUNTS, rows, base)


def caterers(spark, *rows):
    base = dict(city="X", state_code="XX", cuisine_type="Thai", avg_rating=D("4.00"), total_reviews=0,
                onboarded_at=date(2022, 1, 1), is_active=True)
    return make(spark, S.CATERERS, rows, base)


def by(rows, key):
    return {getattr(r, key): r for r in rows}


def test_scorecard_zero_orders_and_on_time_boundaries(spark):
    c = caterers(spark, dict(caterer_id=1, caterer_name="A"), dict(caterer_id=2, caterer_name="B"),
                 dict(caterer_id=3, caterer_name="C", is_active=False))
    sched = ts(2024, 1, 2, 12)
    o = orders(spark,
               dict(actual_delivery=sched),                              # exactly on time
               dict(actual_delivery=ts(2024, 1, 2, 12, 15)),             # 15 min late: inside grace
               dict(actual_delivery=ts(2024, 1, 2, 12, 30)),             # 30 min late
               dict(actual_delivery=ts(2024, 1, 2, 11, 50)),             # 10 min early
               dict(order_status="cancelled", actual_delivery=None))
    res = by(caterer.caterer_scorecard(c, o).collect(), "caterer_name")
    assert set(res) == {"A", "B"}
    a, b = res["A"], res["B"]
    assert (a.total_orders, a.otd_strict_pct, a.otd_15min_grace_pct) == (4, 50.0, 75.0)
    assert a.avg_minutes_late == 8.8          # 8.75 rounds half up
    assert (b.total_orders, b.total_gmv_usd, b.avg_order_value_usd, b.otd_strict_pct) == (0, None, None, None)


def test_tier_null_rating_sorts_last_and_quartiles_balance(spark):
    c = caterers(spark, *[dict(caterer_id=i, caterer_name=f"c{i}", avg_rating=D(f"{i}.00")) for i in range(1, 5)],
                 dict(caterer_id=5, caterer_name="c5", avg_rating=None))
    o = orders(spark, *[dict(caterer_id=i, order_total_usd=D(100 * i)) for i in range(1, 6)])
    res = by(caterer.caterer_tier(c, o, num_ranges=3).collect(), "caterer_name")
    assert res["c5"].composite_score is None and res["c5"].performance_tier == "Platinum"
    tiers = [r.performance_tier for r in res.values()]
    assert sorted(tiers.count(t) for t in set(tiers)) == [1, 1, 1, 2]


def test_pareto_first_account_above_threshold_is_long_tail(spark):
    a = accounts(spark, *[dict(account_id=i) for i in range(1, 5)])
    o = orders(spark, dict(account_id=1, order_total_usd=D("900.00")), dict(account_id=2, order_total_usd=D("50.00")),
               dict(account_id=3, order_total_usd=D("50.00")), dict(account_id=4, order_total_usd=D("50.00"),
                                                                   order_status="cancelled"))
    rows = revenue.revenue_pareto(a, o, num_ranges=2).collect()
    assert [r.gmv_segment for r in rows] == ["Long Tail"] * 3
    assert rows[0].cumulative_gmv_pct == 90.0
    assert rows[1].cumulative_gmv_pct == rows[2].cumulative_gmv_pct == 100.0   # ties share the RANGE frame
    assert sum(r.gmv_share_pct for r in rows) == pytest.approx(100.0)


def test_cadence_latest_gap_and_single_order(spark):
    a = accounts(spark, dict(account_id=1), dict(account_id=2))
    o = orders(spark, *[dict(account_id=1, placed_at=ts(2024, 1, d, 9)) for d in (1, 5, 12)],
               dict(account_id=2, placed_at=ts(2024, 2, 1)))
    res = by(retention.order_cadence(a, o, "2024-12-31").collect(), "account_id")
    assert (res[1].avg_days_between_orders, res[1].latest_gap, res[1].latest_gap_as_written) == (6, 7, 1)
    assert res[1].days_since_last_order_eod == (date(2024, 12, 31) - date(2024, 1, 12)).days
    assert (res[2].avg_days_between_orders, res[2].latest_gap) == (None, None)


def test_churn_zero_gap_is_high_risk(spark):
    a = accounts(spark, dict(account_id=1))
    o = orders(spark, dict(placed_at=ts(2024, 6, 1, 9)), dict(placed_at=ts(2024, 6, 1, 15)))
    (r,) = retention.churn_risk(a, o, "2024-12-31").collect()
    assert (r.avg_days_between_orders, r.churn_risk) == (0, "High Risk")


def test_cohort_period_zero_is_full_retention(spark):
    o = orders(spark, dict(account_id=1, placed_at=ts(2023, 12, 5)), dict(account_id=1, placed_at=ts(2024, 2, 1)),
               dict(account_id=2, placed_at=ts(2023, 12, 20)))
    rows = retention.cohort_retention(o).collect()
    assert [(r.period_number, r.active_accounts, r.retention_pct) for r in rows] == [(0, 2, 100.0), (2, 1, 50.0)]


def test_campaign_roi_labels(spark):
    p = make(spark, S.PROMOTIONS, [dict(promo_id=i, promo_code=f"P{i}") for i in (1, 2, 3)],
             dict(description=None, discount_type="flat", discount_value=D("5.00"), start_date=date(2024, 1, 1),
                  end_date=date(2024, 12, 31), target_tier=None))
    o = orders(spark, dict(discount_usd=D("10.00")), dict(), dict(order_status="cancelled"))
    po = make(spark, S.PROMO_ORDERS, [dict(promo_id=1, order_id=1), dict(promo_id=2, order_id=2),
                                      dict(promo_id=2, order_id=3)])
    res = by(promo.campaign_roi(p, po, o).collect(), "promo_code")
    assert res["P1"].roi_assessment == "ROI Positive" and res["P1"].gmv_per_discount_dollar == 10.0
    assert res["P2"].roi_assessment == "Free Delivery (No Discount Cost)"
    assert res["P2"].orders_with_promo == 2          # the cancelled link is counted, its GMV is not
    assert (res["P3"].orders_with_promo, res["P3"].roi_assessment) == (0, "ROI Negative")


def test_promo_fan_out_counts_twice(spark):
    a = accounts(spark, dict(account_id=1))
    o = orders(spark, dict(), dict())
    po = make(spark, S.PROMO_ORDERS, [dict(promo_id=1, order_id=1), dict(promo_id=2, order_id=1)])
    res = by(promo.promo_vs_nonpromo(a, o, po).collect(), "order_type")
    assert (res["Promo"].order_count, res["Non-Promo"].order_count) == (2, 1)


def test_first_order_lift(spark):
    o = orders(spark, dict(account_id=1, placed_at=ts(2024, 1, 1), order_total_usd=D("300.00")),
               dict(account_id=2, placed_at=ts(2024, 1, 1), order_total_usd=D("100.00")))
    po = make(spark, S.PROMO_ORDERS, [dict(promo_id=1, order_id=1)])
    res = by(promo.first_order_promo(o, po).collect(), "first_order_had_promo")
    assert res[True].promo_ltv_lift_usd == res[False].promo_ltv_lift_usd == 200.0
    assert res[True].promo_ltv_lift_as_written is None


def _assignments(spark, rows):
    return make(spark, S.EXPERIMENT_ASSIGNMENTS, rows, dict(experiment_name="SPRING20"))


def test_experiment_results_windows(spark):
    a = accounts(spark, dict(account_id=1), dict(account_id=2))
    ea = _assignments(spark, [dict(assignment_id=1, account_id=1, variant="treatment", assigned_at=ts(2024, 3, 10, 10)),
                              dict(assignment_id=2, account_id=1, variant="control", assigned_at=ts(2024, 3, 11)),
                              dict(assignment_id=3, account_id=2, variant="control", assigned_at=ts(2024, 3, 10))])
    o = orders(spark, dict(account_id=1, placed_at=ts(2024, 3, 10, 8), order_total_usd=D("300.00")),
               dict(account_id=1, placed_at=ts(2024, 3, 15), order_total_usd=D("100.00")),
               dict(account_id=1, placed_at=ts(2024, 4, 11), order_total_usd=D("50.00")),
               dict(account_id=1, placed_at=ts(2024, 5, 20), order_total_usd=D("70.00")))
    res = by(experiment.experiment_results(ea, a, o).collect(), "account_id")
    r = res[1]
    assert r.variant == "treatment" and r.converted == 1 and r.days_to_first_order == 0
    assert (r.first_order_value, r.first_order_value_true) == (D("100.00"), D("300.00"))
    assert (r.gmv_60d, r.orders_60d) == (D("450.00"), 3)   # day 70 is outside the 60-day window
    assert (res[2].converted, res[2].gmv_60d, res[2].first_order_date) == (0, D("0.00"), None)


def test_variant_reports(spark):
    from pyspark.sql import functions as F
    rows = [(i, "control" if i <= 6 else "treatment", date(2024, 3, 1), "smb", None, int(i % 2 == 0), None, None,
             D("0"), D(str(10 * (i % 4))), 0, D("0")) for i in range(1, 11)]
    cols = ["account_id", "variant", "enrollment_date", "account_tier", "industry", "converted", "first_order_date",
            "days_to_first_order", "first_order_value", "gmv_60d", "orders_60d", "first_order_value_true"]
    res = spark.createDataFrame(rows, "account_id long, variant string, enrollment_date date, account_tier string, "
                                      "industry string, converted long, first_order_date date, days_to_first_order "
                                      "long, first_order_value decimal(10,2), gmv_60d decimal(10,2), orders_60d long, "
                                      "first_order_value_true decimal(10,2)").toDF(*cols)
    srm = by(experiment.srm_check(res).collect(), "variant")
    assert srm["control"].pct_of_total == 60.0 and srm["control"].srm_status == "⚠ SRM DETECTED"
    gmv = by(experiment.gmv_by_variant(res, num_ranges=3).collect(), "variant")
    want = {r.variant: round(float(r.m), 2) for r in res.groupBy("variant").agg(F.median("gmv_60d").alias("m")).collect()}
    assert {k: v.median_gmv_60d for k, v in gmv.items()} == want
    conv = by(experiment.conversion_by_variant(res).collect(), "variant")
    assert conv["control"].conversion_rate_pct == 50.0
    assert conv["control"].wilson_low_pct < 50.0 < conv["control"].wilson_high_pct


def test_funnel_and_ltv_keep_pre_signup_orders(spark):
    a = accounts(spark, dict(account_id=1, created_at=date(2024, 2, 1)), dict(account_id=2, created_at=date(2024, 2, 5)))
    o = orders(spark, dict(account_id=1, placed_at=ts(2024, 1, 22), order_total_usd=D("100.00")),
               dict(account_id=1, placed_at=ts(2024, 6, 1), order_total_usd=D("50.00")))
    (f,) = ltv.signup_funnel(a, o).collect()
    assert (f.accounts_created, f.accounts_converted, f.avg_days_to_convert) == (2, 1, -10.0)
    (row,) = ltv.ltv_by_cohort(a, o).collect()
    assert (row.avg_ltv_30d, row.avg_ltv_lifetime) == (50.0, 75.0)   # the pre-signup order counts


def test_top_accounts_single_order_is_healthy(spark):
    a = accounts(spark, dict(account_id=1), dict(account_id=2))
    o = orders(spark, dict(account_id=1, placed_at=ts(2024, 1, 1)),
               *[dict(account_id=2, placed_at=ts(2024, m, 1)) for m in (1, 2, 3)])
    res = by(ltv.top_accounts_churn(a, o, "2024-12-31").collect(), "account_id")
    assert (res[1].churn_signal, res[1].avg_order_gap_days, res[1].outreach_priority_score) == ("HEALTHY", None, None)
    assert res[2].churn_signal == "AT RISK" and res[2].lifetime_orders == 3


def test_quality_checks_find_violations(spark):
    o = orders(spark, dict(), dict(order_status="shipped", headcount=0, actual_delivery=None),
               dict(order_status="cancelled", account_id=9))
    o = o.union(o.limit(1))                                   # duplicate order_id 1
    a = accounts(spark, dict(account_id=1))
    tables = {"orders": o, "corporate_accounts": a}
    dup = quality.unique_key_check(tables, {"orders": [("order_id",)]}, {}).first()
    assert (dup.n_checked, dup.n_violations) == (4, 2)
    fk = quality.foreign_key_check(tables, [("orders", "account_id", "corporate_accounts", "account_id")]).first()
    assert fk.n_violations == 1
    dom = quality.domain_check(tables, [("orders", "order_status", S.ORDER_STATUSES)]).first()
    assert dom.n_violations == 1
    rng = quality.range_check(tables, [("orders", "headcount", "headcount > 0")]).first()
    assert rng.n_violations == 1
    st = by(quality.status_timestamp_check(o).collect(), "rule")
    assert st["cancelled has cancelled_at"].n_violations == 1
    assert st["actual_delivery only when delivered"].n_violations == 1
    assert quality.foreign_key_rows(o, "account_id", a, "account_id").count() == 1


def test_rolling_otd_counts_rows_not_months(spark):
    c = caterers(spark, dict(caterer_id=1, caterer_name="A", is_active=False))   # inactive still reported
    late = ts(2024, 1, 2, 13)
    o = orders(spark, dict(placed_at=ts(2024, 1, 5)),                               # Jan: 1/1 on time
               dict(placed_at=ts(2024, 1, 6), actual_delivery=late),                # Jan: 1/2
               dict(placed_at=ts(2024, 4, 1), actual_delivery=late),                # Apr: 0/1 (Feb, Mar empty)
               dict(placed_at=ts(2024, 5, 1)), dict(placed_at=ts(2024, 6, 1)))     # May, Jun: 1/1
    rows = caterer.monthly_otd_trend(c, o).collect()
    assert [r.otd_pct for r in rows] == [50.0, 0.0, 100.0, 100.0]
    # mean of unrounded monthly rates over the last three rows that exist
    assert [r.otd_3mo_rolling_avg for r in rows] == [50.0, 25.0, 50.0, 66.7]


def test_yoy_is_twelve_rows_back(spark):
    months = [ts(2023, m, 1) for m in range(1, 13)] + [ts(2024, 2, 1)]             # January 2024 missing
    o = orders(spark, *[dict(placed_at=p, order_total_usd=D("100.00") + i) for i, p in enumerate(months)])
    rows = revenue.monthly_gmv_growth(o).collect()
    last = rows[-1]
    assert last.order_month == date(2024, 2, 1)
    assert last.yoy_growth_pct == 12.0        # 112 vs 100: the row twelve back is January 2023
    assert rows[0].mom_growth_pct is None and last.cumulative_gmv_usd == sum(100 + i for i in range(13))


def test_enrollment_window_applies_before_dedup(spark):
    a = accounts(spark, dict(account_id=1))
    ea = _assignments(spark, [dict(assignment_id=1, account_id=1, variant="control", assigned_at=ts(2024, 2, 20)),
                              dict(assignment_id=2, account_id=1, variant="treatment", assigned_at=ts(2024, 3, 5)),
                              dict(assignment_id=3, account_id=1, variant="control", assigned_at=ts(2024, 3, 5))])
    (r,) = experiment.experiment_enrollment(ea, a).collect()
    assert (r.variant, r.assignment_date) == ("treatment", date(2024, 3, 5))   # first inside the range, tie by id


def _results(spark, rows):
    schema = ("account_id long, variant string, enrollment_date date, account_tier string, industry string, "
              "converted long, first_order_date date, days_to_first_order long, first_order_value decimal(10,2), "
              "gmv_60d decimal(10,2), orders_60d long, first_order_value_true decimal(10,2)")
    full = [(r["id"], r["variant"], r.get("enr", date(2024, 3, 1)), r.get("tier", "smb"), None, r.get("conv", 0),
             None, None, D("0"), D(r.get("gmv", "0")), 0, D("0")) for r in rows]
    return spark.createDataFrame(full, schema)


def test_tier_lifts(spark):
    res = _results(spark, [dict(id=1, variant="control", conv=1), dict(id=2, variant="control"),
                           dict(id=3, variant="treatment", conv=1), dict(id=4, variant="treatment", conv=1),
                           dict(id=5, variant="treatment")])
    r = by(experiment.results_by_tier(res).collect(), "variant")
    assert r["treatment"].lift_vs_control_pp == 16.67          # 66.67 - 50
    assert r["treatment"].lift_vs_tier_mean_pp == 8.33         # 66.67 - mean(50, 66.67)
    assert r["control"].lift_vs_control_pp == 0.0


def test_power_users_and_age_segments(spark):
    res = _results(spark, [dict(id=1, variant="control", conv=1, gmv="10"), dict(id=2, variant="control"),
                           dict(id=3, variant="treatment", enr=date(2022, 12, 1))])
    o = orders(spark, *[dict(account_id=1, placed_at=ts(2024, 2, d)) for d in (1, 2, 3, 4)],
               dict(account_id=2, placed_at=ts(2024, 2, 1)))
    pu = {(r.user_segment, r.variant): r for r in experiment.power_users(res, o).collect()}
    assert pu[("Power User", "control")].avg_pre_exp_orders == 4.0
    assert pu[("Regular User", "control")].avg_pre_exp_orders is None
    a = accounts(spark, dict(account_id=1, created_at=date(2024, 1, 15)), dict(account_id=2, created_at=date(2023, 6, 1)),
                 dict(account_id=3, created_at=date(2023, 1, 1)))
    dated = res.drop("created_at").join(a.select("account_id", "created_at"), "account_id")
    seg = {(r.account_age_segment, r.variant) for r in experiment.account_age(dated).collect()}
    assert seg == {("New Account (< 60 days)", "control"), ("Established Account (180+ days)", "control"),
                   ("New Account (< 60 days)", "treatment")}                  # negative age counts as new


def test_guardrail_drops_accounts_without_orders(spark):
    res = _results(spark, [dict(id=1, variant="control"), dict(id=2, variant="treatment")])
    o = orders(spark, dict(account_id=1, placed_at=ts(2024, 3, 1, 9)),
               dict(account_id=1, placed_at=ts(2024, 3, 20), order_status="cancelled"),
               dict(account_id=1, placed_at=ts(2024, 6, 1)))                  # day 92: outside
    rows = experiment.cancellation_guardrail(res, o).collect()
    assert [(r.variant, r.total_orders, r.cancellations, r.cancellation_rate_pct) for r in rows] == \
        [("control", 2, 1, 50.0)]


def test_calendar_spine_makes_yoy_twelve_months(spark):
    months = [ts(2023, m, 1) for m in range(1, 13)] + [ts(2024, 2, 1)]             # January 2024 missing
    o = orders(spark, *[dict(placed_at=p, order_total_usd=D("100.00") + i) for i, p in enumerate(months)])
    rows = revenue.monthly_gmv_growth(o, calendar=True).collect()
    assert len(rows) == 14 and rows[12].order_count == 0 and rows[12].gmv_usd == 0.0
    assert rows[13].yoy_growth_pct == 10.9    # Feb 2024 (112) against Feb 2023 (101): 10.89 %


def test_promo_dedupe_and_strict_first_order(spark):
    a = accounts(spark, dict(account_id=1))
    o = orders(spark, dict(placed_at=ts(2024, 1, 1)), dict(placed_at=ts(2024, 1, 1)))   # tied first orders
    po = make(spark, S.PROMO_ORDERS, [dict(promo_id=1, order_id=1), dict(promo_id=2, order_id=1)])
    res = by(promo.promo_vs_nonpromo(a, o, po, dedupe=True).collect(), "order_type")
    assert (res["Promo"].order_count, res["Non-Promo"].order_count) == (1, 1)
    as_written = {r.first_order_had_promo: r.accounts for r in promo.first_order_promo(o, po).collect()}
    assert as_written == {True: 2, False: 1}                  # tie and fan-out duplicate the account
    strict = {r.first_order_had_promo: r.accounts for r in promo.first_order_promo(o, po, strict=True).collect()}
    assert strict == {True: 1}


def test_lateness_ignores_session_time_zone(spark):
    """02:30 on a US DST-start day does not exist in local time; lateness must not care."""
    c = caterers(spark, dict(caterer_id=1, caterer_name="A"))
    o = orders(spark, dict(scheduled_delivery=ts(1995, 4, 2, 3), actual_delivery=ts(1995, 4, 2, 2, 30)))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        (r,) = caterer.caterer_scorecard(c, o).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert (r.avg_minutes_late, r.otd_strict_pct) == (-30.0, 100.0)


def test_approximate_medians_are_close(spark):
    from platewise import sources
    from tests.conftest import SF_SMALL
    m = sources.load(spark, SF_SMALL, "test")
    res = experiment.experiment_results(m.experiment_assignments, m.corporate_accounts, m.orders, conv_days=180,
                                        gmv_days=365)
    from platewise.operators import ranking
    middle = {r.variant: (float(r._med_lo), float(r._med_hi))
              for r in ranking.middle_values(res, ["variant"], "gmv_60d").collect()}
    approx = {r.variant: r.median_gmv_60d for r in experiment.gmv_by_variant(res, approx_accuracy=10000).collect()}
    assert middle.keys() == approx.keys()
    for k, (lo, hi) in middle.items():   # an actual value, at or between the two middle ones
        assert lo <= approx[k] <= hi
    f_exact = ltv.signup_funnel(m.corporate_accounts, m.orders).count()
    assert ltv.signup_funnel(m.corporate_accounts, m.orders, approx_accuracy=10000).count() == f_exact


def test_report_suite_equals_standalone_queries(spark):
    from platewise import sources
    from platewise.plans import params as P
    from platewise.plans import registry
    from tests.conftest import SF_SMALL
    m = sources.load(spark, SF_SMALL, "test")
    suite = experiment.report_suite(m.experiment_assignments, m.corporate_accounts, m.orders, P.EXPERIMENT,
                                    P.CONV_DAYS, P.GMV_DAYS, P.LAUNCH, P.LOOKBACK_DAYS, P.MIN_PRE_ORDERS,
                                    P.GMV_DAYS)
    pairs = {"srm_check": "q5d_srm_check", "gmv_by_variant": "q5b2_gmv_by_variant",
             "power_users": "q5c2_power_users", "cancellation_guardrail": "q5e_cancellation_guardrail",
             "results": "q5a2_experiment_results"}
    for name, key in pairs.items():
        assert sorted(suite[name].collect()) == sorted(registry.QUERIES[key](spark, SF_SMALL).collect()), name


def test_unique_keys_on_an_empty_table_report_zero(spark):
    p = make(spark, S.PROMOTIONS, [])
    rows = quality.unique_key_check({"promotions": p, "orders": orders(spark).limit(0)},
                                    {"promotions": [("promo_id",)], "orders": [("order_id",)]})
    assert sorted((r.rule, r.n_checked, r.n_violations) for r in rows.collect()) == [
        ("unique(order_id)", 0, 0), ("unique(promo_code)", 0, 0), ("unique(promo_id)", 0, 0)]


def test_quality_row_twins_and_defaults(spark):
    a = make(spark, S.CORPORATE_ACCOUNTS.__class__([
        f if f.name not in ("account_tier", "is_active") else f.__class__(f.name, f.dataType, True)
        for f in S.CORPORATE_ACCOUNTS.fields]),
        [dict(account_id=1, company_name="A", city="X", state_code="XX", created_at=date(2024, 1, 1)),
         dict(account_id=1, company_name="B", city="X", state_code="XXX", created_at=date(2024, 1, 1),
              account_tier="giant", is_active=True)])
    filled = quality.apply_defaults(a, "corporate_accounts")
    first = filled.filter("company_name = 'A'").first()
    assert (first.account_tier, first.is_active) == ("smb", True)
    assert quality.not_null_rows(a, ["account_tier"]).count() == 1
    assert quality.unique_key_rows(a, ["account_id"]).count() == 2
    assert [r.account_tier for r in quality.domain_rows(a, "account_tier", S.ACCOUNT_TIERS).collect()] == ["giant"]
    lengths = by(quality.length_check({"corporate_accounts": a}, {"corporate_accounts": {"state_code": 2}}).collect(),
                 "rule")
    assert lengths["length(state_code) <= 2"].n_violations == 1


def test_tier_mean_lift_rounds_away_from_zero_on_both_sides(spark):
    res = _results(spark, [dict(id=i, variant="control") for i in range(16)]
                   + [dict(id=100 + i, variant="treatment", conv=int(i == 0)) for i in range(16)])
    lift = {r.variant: r.lift_vs_tier_mean_pp for r in experiment.results_by_tier(res).collect()}
    assert lift == {"control": -3.13, "treatment": 3.13}


def test_rolling_trend_over_a_wide_window(spark):
    c = caterers(spark, dict(caterer_id=1, caterer_name="A"))
    late = ts(2025, 1, 2, 13)
    rows = [dict(placed_at=ts(2022 + m // 12, m % 12 + 1, d), actual_delivery=late if d <= m % 5 else ts(2024, 1, 2, 12))
            for m in range(30) for d in range(1, 12)]
    got = caterer.monthly_otd_trend(c, orders(spark, *rows), window_rows=12).collect()
    rates = [100 * (11 - m % 5) / 11 for m in range(30)]
    assert [r.otd_3mo_rolling_avg for r in got] == [
        pytest.approx(sum(rates[max(0, m - 11):m + 1]) / min(12, m + 1), abs=0.0501) for m in range(30)]


def test_unique_keys_compare_values_as_they_are(spark):
    df = spark.createDataFrame([(1, ts(2024, 1, 1, 0, 0, 0, 1)), (2, ts(2024, 1, 1, 0, 0, 0, 2)), (3, None), (4, None)],
                               "id long, at timestamp_ntz")
    strict = quality.unique_key_check({"t": df}, {"t": [("id",), ("at",)]}, {}).collect()
    assert [(r.rule, r.n_checked, r.n_violations) for r in strict] == [("unique(id)", 4, 0), ("unique(at)", 4, 2)]
    loose = quality.unique_key_check({"t": df}, {}, {"t": [("at",)]}).collect()
    assert [(r.n_checked, r.n_violations) for r in loose] == [(2, 0)]
    assert quality.unique_key_rows(df, ["at"]).count() == 2 and quality.unique_key_rows(df, ["at"], nulls_equal=False).count() == 0


def without(df, **columns):
    """``df`` with a column NULL in the row of the given order."""
    from pyspark.sql import functions as F
    return df.withColumns({c: F.when(F.col("order_id") != i, F.col(c)) for c, i in columns.items()})


def test_offending_rows_of_every_kind(spark):
    o = without(orders(spark, dict(), dict(headcount=0), dict(order_total_usd=D("-1.00")), dict(),
                       dict(order_status="cancelled"), dict()), headcount=4, delivery_tier=6)
    ids = lambda df: sorted(r.order_id for r in df.collect())
    assert ids(quality.range_rows(o, [("headcount", "headcount > 0"), ("order_total_usd", "order_total_usd >= 0")])) == [2, 3]
    assert ids(quality.default_fill_rows(o, {"delivery_tier": "standard", "order_status": "pending"})) == [6]
    assert ids(quality.status_timestamp_rows(o)) == [5]
    a = accounts(spark, dict(account_id=1, state_code="XX"), dict(account_id=2, state_code="XXX"), dict(account_id=3, industry=None))
    assert [r.account_id for r in quality.length_rows(a, {"state_code": 2, "industry": 80}).collect()] == [2]
    assert quality.range_rows(o, []).count() == 0


def test_all_rules_of_a_table_equal_the_single_kinds(spark):
    o = without(orders(spark, dict(), dict(headcount=0, order_status="shipped"), dict()), caterer_id=3)
    every = {(r.rule, r.n_checked, r.n_violations) for r in quality.table_rules_check({"orders": o}).collect()}
    kinds = [quality.not_null_check({"orders": o}), quality.domain_check({"orders": o}, [d for d in quality.DOMAINS if d[0] == "orders"]),
             quality.range_check({"orders": o}, [r for r in quality.RANGES if r[0] == "orders"]), quality.status_timestamp_check(o),
             quality.default_fill_check({"orders": o}, {"orders": quality.DEFAULTS["orders"]})]
    assert every == {(r.rule, r.n_checked, r.n_violations) for k in kinds for r in k.collect()}


def test_headcounts_that_are_missing_are_not_averaged(spark):
    a, c = accounts(spark, dict(account_id=1)), caterers(spark, dict(caterer_id=1, caterer_name="A"))
    o = without(orders(spark, dict(headcount=10), dict(), dict(headcount=20)), headcount=2)
    none = make(spark, S.PROMO_ORDERS, [])
    assert [(r.order_count, r.avg_headcount) for r in promo.promo_vs_nonpromo(a, o, none).collect()] == [(3, 15.0)]
    assert [(r.total_orders, r.avg_headcount) for r in caterer.caterer_scorecard(c, o).collect()] == [(3, 15.0)]


def test_ties_have_one_order_for_any_partitioning(spark):
    a = accounts(spark, *[dict(account_id=i) for i in range(1, 60)])
    o = orders(spark, *[dict(account_id=i) for i in range(1, 60)])  # all at one dormancy
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        runs = []
        for n in ("1", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            runs.append([r.account_id for r in retention.order_cadence(a, o.repartition(int(n))).collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert runs[0] == runs[1] == list(range(1, 60))
