"""DuckDB SQL for every registered query: the correctness oracle.

Each statement is written from the definition of its report: what is counted
or summed per entity, and what the report shows of it.  It works over views of
the raw test tables joined here, rounds with SQL's own ROUND on a DECIMAL, and
states the data-quality rules as literals, so it shares neither the library's
distributed forms nor its rounding nor its rule tables.  Only the test tables'
mapping rules, the label texts and the parameters are common fixed values.
"""

from __future__ import annotations

from ..sources import adapter as A
from ..sources import labels as L
from . import params as P


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _r(expr: str, digits: int, places: int = 9) -> str:
    """ROUND of a NUMERIC; ``places`` of the value count (fewer for large money, whose double has no more)."""
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(38,{places})), {digits}) AS DOUBLE)"


def _n(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def _d(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def _month(ts: str) -> str:
    return f"CAST(date_trunc('month', {ts}) AS DATE)"


def _cols(exprs: list[str]) -> str:
    return ",\n    ".join(exprs)


# Inside its own body the view ``orders`` reads the raw table it shadows.
VIEWS = f"""
corporate_accounts AS (
  SELECT {_cols(A.ACCOUNT_COLUMNS)}
  FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey
),
caterers AS (
  SELECT {_cols(A.CATERER_COLUMNS)}
  FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey
),
orders AS (
  SELECT {_cols(A.ORDER_COLUMNS)}
  FROM (SELECT *, (SELECT MIN(l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS m,
                  (SELECT SUM(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS q FROM orders)
),
promotions AS (SELECT {_cols(A.PROMOTION_COLUMNS)} FROM part WHERE {A.PROMOTION_FILTER}),
promo_orders AS (
  SELECT {_cols(A.PROMO_LINK_COLUMNS)} FROM lineitem
  WHERE l_partkey IN (SELECT p_partkey FROM part WHERE {A.PROMOTION_FILTER})
  GROUP BY ALL
),
order_items AS (SELECT {_cols(A.ITEM_COLUMNS)} FROM lineitem, part WHERE l_partkey = p_partkey),
delivery_events AS (SELECT {_cols(A.EVENT_COLUMNS)} FROM events),
experiment_assignments AS (SELECT {_cols(A.ASSIGNMENT_COLUMNS)} FROM events WHERE {A.ASSIGNMENT_FILTER})"""


def _with(body: str) -> str:
    return f"WITH {VIEWS}{body}"


def _pct(part: str, whole: str, digits: int) -> str:
    return _r(f"100.0 * ({part}) / NULLIF({whole}, 0)", digits)


# --- suppliers ---------------------------------------------------------------------------------

def q1a() -> str:
    late = "date_diff('microsecond', o.scheduled_delivery, o.actual_delivery)"
    return _with(f"""
SELECT c.caterer_name, c.cuisine_type, {_d('ANY_VALUE(c.avg_rating)')} AS avg_rating,
       {_n('COUNT(o.order_id)')} AS total_orders, {_d('SUM(o.order_total_usd)')} AS total_gmv_usd,
       {_r('AVG(o.order_total_usd)', 2)} AS avg_order_value_usd, {_r('AVG(o.headcount)', 1)} AS avg_headcount,
       {_pct(f'COUNT(*) FILTER (WHERE {late} <= 0)', 'COUNT(o.order_id)', 1)} AS otd_strict_pct,
       {_pct(f'COUNT(*) FILTER (WHERE {late} <= 900e6)', 'COUNT(o.order_id)', 1)} AS otd_15min_grace_pct,
       {_r(f'AVG({late} / 60e6)', 1)} AS avg_minutes_late
FROM caterers c LEFT JOIN orders o
  ON o.caterer_id = c.caterer_id AND o.order_status = 'delivered' AND o.actual_delivery IS NOT NULL
WHERE c.is_active
GROUP BY c.caterer_id, c.caterer_name, c.cuisine_type""")


def q1b() -> str:
    return _with(f"""
SELECT caterer_name, order_month, orders, {_r('rate', 1)} AS otd_pct,
       {_r('AVG(rate) OVER (PARTITION BY caterer_id ORDER BY order_month ROWS 2 PRECEDING)', 1)} AS otd_3mo_rolling_avg
FROM (SELECT caterer_id, caterer_name, {_month('placed_at')} AS order_month, {_n('COUNT(*)')} AS orders,
             100.0 * COUNT(*) FILTER (WHERE actual_delivery <= scheduled_delivery) / COUNT(*) AS rate
      FROM orders JOIN caterers USING (caterer_id)
      WHERE order_status = 'delivered' AND actual_delivery IS NOT NULL GROUP BY ALL)""")


def q1c() -> str:
    badges = " ".join(f"WHEN {q} THEN {_lit(v)}" for q, v in L.TIER_LABELS.items())
    return _with(f""",
book AS (
  SELECT caterer_id, COUNT(*) AS placed, SUM(order_total_usd) AS gmv,
         {_pct('COUNT(*) FILTER (WHERE actual_delivery <= scheduled_delivery)',
               "COUNT(*) FILTER (WHERE order_status = 'delivered')", 1)} AS on_time
  FROM orders GROUP BY caterer_id
),
rated AS (
  SELECT caterer_id, caterer_name, {_d('avg_rating')} AS rating, COALESCE(placed, 0) AS placed, COALESCE(gmv, 0) AS gmv, on_time,
         0.4::DOUBLE * PERCENT_RANK() OVER (ORDER BY COALESCE(gmv, 0)) + 0.35::DOUBLE * COALESCE(on_time, 0) / 100::DOUBLE
           + 0.25::DOUBLE * ({_d('avg_rating')} - 1::DOUBLE) / 4::DOUBLE AS points
  FROM caterers LEFT JOIN book USING (caterer_id) WHERE is_active
)
SELECT caterer_name, {_n('placed')} AS total_orders, {_d('gmv')} AS total_gmv, rating AS avg_rating, on_time AS otd_pct,
       {_r('points', 4)} AS composite_score,
       CASE NTILE(4) OVER (ORDER BY points NULLS LAST, caterer_id) {badges} END AS performance_tier
FROM rated""")


# --- revenue -----------------------------------------------------------------------------------

def q2a() -> str:
    growth = lambda rows: _r(f"100.0 * (gmv - LAG(gmv, {rows}) OVER m) / NULLIF(LAG(gmv, {rows}) OVER m, 0)", 1)
    return _with(f"""
SELECT order_month, order_count, {_d('gmv')} AS gmv_usd, {_d('discounts')} AS total_discounts_usd,
       {_d('gmv - discounts')} AS net_revenue_usd, {growth(1)} AS mom_growth_pct, {growth(12)} AS yoy_growth_pct,
       {_d('SUM(gmv) OVER (m ROWS UNBOUNDED PRECEDING)')} AS cumulative_gmv_usd
FROM (SELECT {_month('placed_at')} AS order_month, {_n('COUNT(*)')} AS order_count,
             SUM(order_total_usd) AS gmv, SUM(discount_usd) AS discounts
      FROM orders WHERE order_status = 'delivered' GROUP BY ALL)
WINDOW m AS (ORDER BY order_month)""")


def q2b(threshold: int = 80) -> str:
    return _with(f""",
spend AS (
  SELECT account_id, COUNT(*) AS bought, SUM(order_total_usd) AS spent FROM orders
  WHERE order_status = 'delivered' GROUP BY account_id
),
shares AS (
  SELECT company_name, account_tier, industry, bought, spent, {_pct('spent', 'SUM(spent) OVER ()', 2)} AS share,
         {_pct('SUM(spent) OVER (ORDER BY spent DESC)', 'SUM(spent) OVER ()', 1)} AS running
  FROM spend JOIN corporate_accounts USING (account_id)
)
SELECT company_name, account_tier, industry, {_n('bought')} AS total_orders, {_d('spent')} AS total_gmv,
       share AS gmv_share_pct, running AS cumulative_gmv_pct,
       IF(running <= {threshold}, {_lit(L.PARETO_TOP.format(threshold=threshold))}, {_lit(L.PARETO_TAIL)}) AS gmv_segment
FROM shares""")


def q2c() -> str:
    return _with(f"""
SELECT account_tier, CAST(date_trunc('quarter', placed_at) AS DATE) AS order_quarter,
       {_n('COUNT(DISTINCT account_id)')} AS active_accounts, {_n('COUNT(*)')} AS total_orders,
       {_d('SUM(order_total_usd)')} AS gmv_usd, {_r('AVG(order_total_usd)', 2)} AS avg_order_value_usd,
       {_r('COUNT(*) / COUNT(DISTINCT account_id)', 2)} AS orders_per_account
FROM orders JOIN corporate_accounts USING (account_id)
WHERE order_status = 'delivered' GROUP BY ALL""")


# --- retention ---------------------------------------------------------------------------------

#: Per account the days of its live orders in order, and the days between one and the next.
DIARY = """,
diary AS (
  SELECT account_id, dates, [dates[i + 1] - dates[i] for i in range(1, len(dates))] AS waits, spent, moments
  FROM (SELECT account_id, list(CAST(placed_at AS DATE) ORDER BY placed_at, order_id) AS dates,
               SUM(order_total_usd) AS spent, COUNT(DISTINCT placed_at) AS moments
        FROM orders WHERE order_status <> 'cancelled' GROUP BY account_id)
)"""
USUAL_WAIT = "CAST(ROUND(list_avg(waits), 0) AS BIGINT)"


def q3a(today: str = P.ANALYSIS_DATE) -> str:
    return _with(f"""{DIARY}
SELECT account_id, company_name, account_tier, {_n('len(dates)')} AS lifetime_orders, dates[1] AS first_order_date,
       dates[-1] AS most_recent_order, {USUAL_WAIT} AS avg_days_between_orders, {_n('waits[-1]')} AS latest_gap,
       {_n('1')} AS latest_gap_as_written, {_n(f"DATE '{today}' - dates[-1]")} AS days_since_last_order_eod
FROM diary JOIN corporate_accounts USING (account_id)""")


def q3b() -> str:
    return _with(f""",
present AS (
  SELECT DISTINCT account_id, {_month('placed_at')} AS seen,
         MIN({_month('placed_at')}) OVER (PARTITION BY account_id) AS joined
  FROM orders WHERE order_status <> 'cancelled'
)
SELECT joined AS cohort_month, {_n('FIRST_VALUE(COUNT(*)) OVER (PARTITION BY joined ORDER BY seen)')} AS cohort_size,
       seen AS activity_month, {_n("date_diff('month', joined, seen)")} AS period_number, {_n('COUNT(*)')} AS active_accounts,
       {_pct('COUNT(*)', 'FIRST_VALUE(COUNT(*)) OVER (PARTITION BY joined ORDER BY seen)', 1)} AS retention_pct
FROM present GROUP BY joined, seen""")


def q3c(today: str = P.ANALYSIS_DATE) -> str:
    return _with(f"""{DIARY}
SELECT account_id, company_name, account_tier, industry, {_n('len(dates)')} AS lifetime_orders, {_d('spent')} AS lifetime_gmv,
       dates[-1] AS last_order_date, {USUAL_WAIT} AS avg_days_between_orders, {_n(f"DATE '{today}' - dates[-1]")} AS days_dormant,
       CASE WHEN (DATE '{today}' - dates[-1]) > 2 * {USUAL_WAIT} THEN {_lit(L.CHURN_LABELS[0])}
            WHEN 2 * (DATE '{today}' - dates[-1]) > 3 * {USUAL_WAIT} THEN {_lit(L.CHURN_LABELS[1])}
            ELSE {_lit(L.CHURN_LABELS[2])} END AS churn_risk
FROM diary JOIN corporate_accounts USING (account_id) WHERE len(dates) >= 2""")


# --- promotions --------------------------------------------------------------------------------

def q4a() -> str:
    return _with(f""",
sold AS (SELECT * FROM orders WHERE order_status = 'delivered'),
entries AS (
  SELECT sold.*, {_lit(L.PROMO)} AS order_type FROM promo_orders JOIN sold USING (order_id)
  UNION ALL
  SELECT *, {_lit(L.NON_PROMO)} FROM sold WHERE order_id NOT IN (SELECT order_id FROM promo_orders)
)
SELECT account_tier, order_type, {_n('COUNT(*)')} AS order_count, {_r('AVG(order_total_usd)', 2)} AS avg_order_value_usd,
       {_r('AVG(discount_usd)', 2)} AS avg_discount_usd, {_r('AVG(order_total_usd - discount_usd)', 2)} AS avg_net_revenue_usd,
       {_r('AVG(headcount)', 1)} AS avg_headcount, {_pct('SUM(discount_usd)', 'SUM(order_total_usd)', 2)} AS discount_rate_pct
FROM entries JOIN corporate_accounts USING (account_id) GROUP BY ALL""")


def q4b(roi: int = 5) -> str:
    return _with(f""",
used AS (
  SELECT promo_id, COUNT(*) AS uses, SUM(order_total_usd) FILTER (WHERE order_status = 'delivered') AS sales,
         SUM(discount_usd) FILTER (WHERE order_status = 'delivered') AS given
  FROM promo_orders LEFT JOIN orders USING (order_id) GROUP BY promo_id
)
SELECT promo_code, description, discount_type, target_tier, start_date, end_date, {_n('COALESCE(uses, 0)')} AS orders_with_promo,
       {_d('sales')} AS gross_gmv_usd, {_d('given')} AS total_discount_cost_usd, {_d('sales - given')} AS net_gmv_usd,
       {_r('sales / NULLIF(given, 0)', 2)} AS gmv_per_discount_dollar,
       CASE WHEN given = 0 THEN {_lit(L.ROI_LABELS[1])} WHEN sales / NULLIF(given, 0) >= {roi} THEN {_lit(L.ROI_LABELS[0])}
            ELSE {_lit(L.ROI_LABELS[2])} END AS roi_assessment
FROM promotions LEFT JOIN used USING (promo_id)""")


def q4c() -> str:
    return _with(f""",
opening AS (
  SELECT * FROM orders
  QUALIFY placed_at = MIN(placed_at) FILTER (WHERE order_status <> 'cancelled') OVER (PARTITION BY account_id)
),
starts AS (
  SELECT account_id, TRUE AS promoted FROM opening JOIN promo_orders USING (order_id)
  UNION ALL
  SELECT account_id, FALSE FROM opening WHERE order_id NOT IN (SELECT order_id FROM promo_orders)
),
worth AS (
  SELECT promoted, bought, spent FROM starts
  JOIN (SELECT account_id, COUNT(*) AS bought, SUM(order_total_usd) AS spent FROM orders
        WHERE order_status = 'delivered' GROUP BY account_id) USING (account_id)
)
SELECT promoted AS first_order_had_promo, {_n('COUNT(*)')} AS accounts, {_r('AVG(bought)', 1)} AS avg_lifetime_orders,
       {_r('AVG(spent)', 2, 6)} AS avg_lifetime_gmv_usd,
       (SELECT {_r('AVG(spent) FILTER (WHERE promoted) - AVG(spent) FILTER (WHERE NOT promoted)', 2, 6)} FROM worth) AS promo_ltv_lift_usd,
       CAST(NULL AS DOUBLE) AS promo_ltv_lift_as_written
FROM worth GROUP BY promoted""")


# --- experiment --------------------------------------------------------------------------------

def q5a1(name: str = P.EXPERIMENT, start: str = P.ENROLL_START, end: str = P.ENROLL_END) -> str:
    return _with(f"""
SELECT account_id, experiment_name, variant, assignment_date, account_tier, industry, city
FROM (SELECT DISTINCT ON (account_id) account_id, experiment_name, variant, CAST(assigned_at AS DATE) AS assignment_date
      FROM experiment_assignments
      WHERE experiment_name = '{name}' AND assigned_at >= '{start}' AND assigned_at < '{end}'
      ORDER BY account_id, assigned_at, assignment_id)
JOIN corporate_accounts USING (account_id)""")


def outcomes(name: str = P.EXPERIMENT, conv: int = P.CONV_DAYS, horizon: int = P.GMV_DAYS) -> str:
    """One row per enrolled account; ``since`` counts the days from enrollment to a delivered order."""
    return f""",
enrolled AS (
  SELECT * FROM (SELECT DISTINCT ON (account_id) account_id, variant, CAST(assigned_at AS DATE) AS day0
                 FROM experiment_assignments WHERE experiment_name = '{name}'
                 ORDER BY account_id, assigned_at, assignment_id)
  JOIN (SELECT account_id, account_tier, industry, created_at FROM corporate_accounts) USING (account_id)
),
followed AS (
  SELECT e.*, o.order_id, o.placed_at, o.order_total_usd AS paid, date_diff('day', e.day0, CAST(o.placed_at AS DATE)) AS since
  FROM enrolled e LEFT JOIN orders o ON o.account_id = e.account_id AND o.order_status = 'delivered'
),
outcome AS (
  SELECT account_id, variant, day0, account_tier, industry, created_at,
         COALESCE(BOOL_OR(since BETWEEN 0 AND {conv}), FALSE) AS won,
         MIN(since) FILTER (WHERE since BETWEEN 0 AND {conv}) AS wait,
         COALESCE(MIN(paid) FILTER (WHERE since BETWEEN 0 AND {conv}), 0) AS least_paid,
         COALESCE(ARG_MIN(paid, (placed_at, order_id)) FILTER (WHERE since BETWEEN 0 AND {conv}), 0) AS first_paid,
         COALESCE(SUM(paid) FILTER (WHERE since BETWEEN 0 AND {horizon}), 0) AS spent,
         COUNT(*) FILTER (WHERE since BETWEEN 0 AND {horizon}) AS bought
  FROM followed GROUP BY ALL
)"""


def q5a2() -> str:
    return _with(f"""{outcomes()}
SELECT account_id, variant, day0 AS enrollment_date, account_tier, industry, {_n('won')} AS converted,
       CAST(day0 + CAST(wait AS INTEGER) AS DATE) AS first_order_date, {_n('wait')} AS days_to_first_order,
       {_d('least_paid')} AS first_order_value, {_d('spent')} AS gmv_60d, {_n('bought')} AS orders_60d,
       {_d('first_paid')} AS first_order_value_true
FROM outcome""")


def q5b1() -> str:
    return _with(f"""{outcomes()},
sides AS (
  SELECT variant, COUNT(*) AS n, COUNT(*) FILTER (WHERE won) AS k, {_d('AVG(won::INT)')} AS p, STDDEV_SAMP(won::INT) AS sd
  FROM outcome GROUP BY variant
),
wilson AS (
  SELECT *, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS mid,
         1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n) AS reach
  FROM sides
)
SELECT variant, {_n('n')} AS n_accounts, {_n('k')} AS conversions, {_pct('k', 'n', 2)} AS conversion_rate_pct,
       {_r('100 * 1.96 * sd / sqrt(n)', 2)} AS margin_of_error_pct, {_r('100 * (mid - reach)', 2)} AS wilson_low_pct,
       {_r('100 * (mid + reach)', 2)} AS wilson_high_pct
FROM wilson""")


def q5b2() -> str:
    return _with(f"""{outcomes()}
SELECT variant, {_n('COUNT(*)')} AS n_accounts, {_n('COUNT(*) FILTER (WHERE won)')} AS n_converters,
       {_r('AVG(least_paid) FILTER (WHERE won)', 2)} AS avg_first_order_gmv, {_r('AVG(spent)', 2)} AS avg_gmv_60d,
       {_r(f"MEDIAN({_d('spent')})", 2)} AS median_gmv_60d, {_r(f"STDDEV_SAMP({_d('spent')})", 2)} AS stddev_gmv_60d,
       {_d('SUM(spent)')} AS total_gmv_60d
FROM outcome GROUP BY variant""")


def q5c1(control: str = "control") -> str:
    return _with(f"""{outcomes()},
cells AS (
  SELECT account_tier, variant, COUNT(*) AS n, 100.0 * AVG(won::INT) AS rate, {_r('AVG(spent)', 2)} AS mean_spent
  FROM outcome GROUP BY ALL
)
SELECT account_tier, variant, {_n('n')} AS n_accounts, {_r('rate', 2)} AS conversion_rate_pct, mean_spent AS avg_gmv_60d,
       {_r('rate - AVG(rate) OVER (PARTITION BY account_tier)', 2)} AS lift_vs_tier_mean_pp,
       {_r(f"rate - ANY_VALUE(rate) FILTER (WHERE variant = '{control}') OVER (PARTITION BY account_tier)", 2)} AS lift_vs_control_pp
FROM cells""")


def _cut(segment: str, name: str, source: str, extra: str = "") -> str:
    return f"""
SELECT {segment} AS {name}, variant, {_n('COUNT(*)')} AS n_accounts, {_r('100.0 * AVG(won::INT)', 2)} AS conversion_rate_pct,
       {_r('AVG(spent)', 2)} AS avg_gmv_60d{extra}
FROM {source} GROUP BY ALL"""


def q5c2(launch: str = P.LAUNCH, lookback: int = P.LOOKBACK_DAYS, least: int = P.MIN_PRE_ORDERS) -> str:
    return _with(outcomes() + f""",
habit AS (
  SELECT outcome.*, NULLIF(COUNT(o.order_id), 0) AS before_launch
  FROM outcome LEFT JOIN orders o ON o.account_id = outcome.account_id AND o.order_status = 'delivered'
   AND CAST(o.placed_at AS DATE) BETWEEN DATE '{launch}' - {lookback} AND DATE '{launch}' - 1
  GROUP BY ALL
)""" + _cut(f"IF(before_launch >= {least}, {_lit(L.POWER_USER)}, {_lit(L.REGULAR_USER)})", "user_segment", "habit",
            f", {_r(f'AVG(before_launch) FILTER (WHERE before_launch >= {least})', 1)} AS avg_pre_exp_orders"))


def q5c3() -> str:
    age = "day0 - created_at"
    return _with(outcomes() + _cut(
        f"CASE WHEN {age} >= 180 THEN {_lit(L.AGE_LABELS[2])} WHEN {age} >= 60 THEN {_lit(L.AGE_LABELS[1])} ELSE {_lit(L.AGE_LABELS[0])} END",
        "account_age_segment", "outcome"))


def experiment_read_out(launch: str = P.LAUNCH, lookback: int = P.LOOKBACK_DAYS, least: int = P.MIN_PRE_ORDERS) -> str:
    age = "day0 - created_at"
    ages = (f"CASE WHEN {age} >= 180 THEN {_lit(L.AGE_LABELS[2])} WHEN {age} >= 60 THEN {_lit(L.AGE_LABELS[1])} "
            f"ELSE {_lit(L.AGE_LABELS[0])} END")
    habit = (f"(SELECT COUNT(*) FROM orders o WHERE o.account_id = outcome.account_id AND o.order_status = 'delivered'"
             f" AND CAST(o.placed_at AS DATE) BETWEEN DATE '{launch}' - {lookback} AND DATE '{launch}' - 1)")
    cuts = {"variant": "NULL", "account_tier": "account_tier", "account_age_segment": ages,
            "user_segment": f"IF({habit} >= {least}, {_lit(L.POWER_USER)}, {_lit(L.REGULAR_USER)})"}
    rows = " UNION ALL ".join(f"SELECT '{c}' AS cut, {expr} AS segment, variant, won, spent FROM outcome" for c, expr in cuts.items())
    return _with(f"""{outcomes()}
SELECT cut, segment, variant, {_n('COUNT(*)')} AS n_accounts, {_n('COUNT(*) FILTER (WHERE won)')} AS conversions,
       {_pct('COUNT(*) FILTER (WHERE won)', 'COUNT(*)', 2)} AS conversion_rate_pct, {_r('AVG(spent)', 2)} AS avg_gmv_60d
FROM ({rows}) GROUP BY cut, segment, variant""")


def q5d(expected: str = "0.5", tolerance: str = "0.02") -> str:
    return _with(f"""{outcomes()}
SELECT variant, {_n('n')} AS n_enrolled, {_pct('n', 'every', 2)} AS pct_of_total,
       IF(ABS(n - {expected} * every) > {tolerance} * every, {_lit(L.SRM_LABELS[0])}, {_lit(L.SRM_LABELS[1])}) AS srm_status
FROM (SELECT variant, COUNT(*) AS n, (SELECT COUNT(*) FROM enrolled) AS every FROM enrolled GROUP BY variant)""")


def q5e(days: int = P.GMV_DAYS) -> str:
    return _with(f"""{outcomes()}
SELECT variant, {_n('COUNT(*)')} AS total_orders, {_n("COUNT(*) FILTER (WHERE order_status = 'cancelled')")} AS cancellations,
       {_pct("COUNT(*) FILTER (WHERE order_status = 'cancelled')", 'COUNT(*)', 2)} AS cancellation_rate_pct
FROM orders JOIN enrolled USING (account_id)
WHERE date_diff('day', day0, CAST(placed_at AS DATE)) BETWEEN 0 AND {days} GROUP BY variant""")


# --- lifetime value ----------------------------------------------------------------------------

def q6a() -> str:
    return _with(f""",
waits AS (
  SELECT {_month('created_at')} AS cohort,
         (SELECT MIN(CAST(placed_at AS DATE)) FROM orders o
          WHERE o.account_id = a.account_id AND o.order_status <> 'cancelled') - created_at AS days
  FROM corporate_accounts a
),
cohorts AS (
  SELECT cohort, COUNT(*) AS n, COUNT(days) AS k, {_pct('COUNT(days)', 'COUNT(*)', 1)} AS rate,
         {_r('AVG(days)', 1)} AS mean_days, MEDIAN(days) AS mid_days
  FROM waits GROUP BY cohort
)
SELECT cohort AS signup_cohort, {_n('n')} AS accounts_created, {_n('k')} AS accounts_converted, rate AS conversion_rate_pct,
       mean_days AS avg_days_to_convert, {_d('mid_days')} AS median_days_to_convert,
       {_r('rate / NULLIF(mean_days, 0)', 2)} AS cohort_quality_index
FROM cohorts""")


def q6b() -> str:
    within = lambda d: f"COALESCE(SUM(paid) FILTER (WHERE since <= {d}), 0) AS ltv_{d}"
    mean = lambda c: _r(f"AVG({c})", 0, 6)
    return _with(f""",
purchases AS (
  SELECT account_id, account_tier, {_month('created_at')} AS cohort, order_id, order_total_usd AS paid,
         CAST(placed_at AS DATE) - created_at AS since
  FROM corporate_accounts LEFT JOIN (SELECT * FROM orders WHERE order_status <> 'cancelled') USING (account_id)
),
values_ AS (
  SELECT account_id, account_tier, cohort, {within(30)}, {within(90)}, {within(180)}, COALESCE(SUM(paid), 0) AS ltv, COUNT(order_id) AS bought
  FROM purchases GROUP BY ALL
)
SELECT cohort AS signup_cohort, account_tier, {_n('COUNT(*)')} AS accounts, {mean('ltv_30')} AS avg_ltv_30d, {mean('ltv_90')} AS avg_ltv_90d,
       {mean('ltv_180')} AS avg_ltv_180d, {mean('ltv')} AS avg_ltv_lifetime, {_r('AVG(bought)', 1)} AS avg_orders,
       {_r('SUM(ltv_90) / NULLIF(SUM(ltv_30), 0)', 2)} AS ltv_expansion_90d_vs_30d
FROM values_ GROUP BY ALL""")


def q6c(today: str = P.ANALYSIS_DATE, k: int = 20) -> str:
    risk, fine = map(_lit, L.CHURN_SIGNALS)
    return _with(f"""{DIARY},
idle AS (
  SELECT account_id, company_name, account_tier, industry, spent, moments, dates[-1] AS seen,
         DATE '{today}' - dates[-1] AS days, {USUAL_WAIT} AS usual,
         COALESCE(DATE '{today}' - dates[-1] > 2 * {USUAL_WAIT}, FALSE) AS overdue
  FROM diary JOIN corporate_accounts USING (account_id) WHERE spent > 0
)
SELECT account_id, company_name, account_tier, industry, {_d('spent')} AS lifetime_gmv, {_n('moments')} AS lifetime_orders,
       seen AS last_order_date, {_n('days')} AS days_inactive, usual AS avg_order_gap_days,
       IF(overdue AND moments >= 3, {risk}, {fine}) AS churn_signal,
       {_r('spent * days / NULLIF(usual, 0)', 0, 3)} AS outreach_priority_score
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY overdue ORDER BY spent DESC, account_id) AS place FROM idle) WHERE place <= {k}""")


# --- data quality ------------------------------------------------------------------------------
# The constraints that the schema declares, one line each.

NOT_NULL = """
corporate_accounts: account_id company_name account_tier city state_code created_at is_active
caterers: caterer_id caterer_name city state_code total_reviews onboarded_at is_active
orders: order_id account_id caterer_id order_status delivery_tier headcount order_total_usd delivery_fee_usd discount_usd placed_at scheduled_delivery
order_items: order_id line_number item_name unit_price_usd quantity
delivery_events: event_id order_id event_type event_ts
promotions: promo_id promo_code discount_type discount_value start_date end_date
promo_orders: promo_id order_id
experiment_assignments: assignment_id account_id experiment_name variant assigned_at
"""
KEYS = """
corporate_accounts: account_id
caterers: caterer_id
orders: order_id
order_items: order_id, line_number
delivery_events: event_id
promotions: promo_id
promotions: promo_code
promo_orders: promo_id, order_id
"""
REFERENCES = """
orders: account_id references corporate_accounts(account_id)
orders: caterer_id references caterers(caterer_id)
order_items: order_id references orders(order_id)
delivery_events: order_id references orders(order_id)
promo_orders: promo_id references promotions(promo_id)
promo_orders: order_id references orders(order_id)
"""
ALLOWED = """
orders: order_status in (pending, confirmed, in_transit, delivered, cancelled)
orders: delivery_tier in (standard, express, scheduled)
corporate_accounts: account_tier in (smb, mid_market, enterprise)
promotions: target_tier in (smb, mid_market, enterprise)
promotions: discount_type in (flat, percent, free_delivery)
delivery_events: event_type in (dispatched, arrived, completed, failed)
order_items: category in (Entree, Side, Beverage, Dessert)
"""
LIMITS = """
caterers: avg_rating BETWEEN 1.0 AND 5.0
orders: headcount > 0
orders: order_total_usd >= 0
order_items: unit_price_usd >= 0
order_items: quantity > 0
"""
LENGTHS = """
corporate_accounts: length(company_name) <= 120
corporate_accounts: length(industry) <= 80
corporate_accounts: length(city) <= 60
corporate_accounts: length(state_code) <= 2
caterers: length(caterer_name) <= 120
caterers: length(city) <= 60
caterers: length(state_code) <= 2
caterers: length(cuisine_type) <= 60
order_items: length(item_name) <= 120
order_items: length(category) <= 60
delivery_events: length(event_type) <= 40
promotions: length(promo_code) <= 30
promotions: length(description) <= 200
promotions: length(discount_type) <= 20
"""
FILLS = """
corporate_accounts: account_tier = 'smb'
corporate_accounts: is_active = True
caterers: total_reviews = 0
caterers: is_active = True
orders: order_status = 'pending'
orders: delivery_tier = 'standard'
orders: delivery_fee_usd = 0
orders: discount_usd = 0
"""


def _rules(text: str) -> list[list[str]]:
    return [line.split(": ", 1) for line in text.strip().splitlines()]


def _report(rows: list[tuple[str, str, str, str]]) -> str:
    """``(table, rule, rows it applies to, rows that break it)`` counted one by one."""
    return _with("\n" + "\nUNION ALL\n".join(
        f"SELECT {_lit(t)} AS table_name, {_lit(rule)} AS rule, {_n(f'COUNT(*) FILTER (WHERE {applies})')} AS n_checked, "
        f"{_n(f'COUNT(*) FILTER (WHERE ({applies}) AND ({breaks}))')} AS n_violations FROM {t}" for t, rule, applies, breaks in rows))


def not_null_rules() -> list:
    return [(t, f"not_null({c})", "TRUE", f"{c} IS NULL") for t, cs in _rules(NOT_NULL) for c in cs.split()]


def dq_unique_key() -> str:
    """Rows that share their key; a UNIQUE constraint, unlike a primary key, says nothing of a NULL."""
    unique = {("promotions", "promo_code")}
    applies = lambda t, key: f"{key} IS NOT NULL" if (t, key) in unique else "TRUE"
    return _with("\n" + "\nUNION ALL\n".join(
        f"SELECT {_lit(t)} AS table_name, {_lit(f'unique({key})')} AS rule, {_n('COUNT(*)')} AS n_checked, "
        f"{_n('COUNT(*) FILTER (WHERE twins > 1)')} AS n_violations "
        f"FROM (SELECT COUNT(*) OVER (PARTITION BY {key}) AS twins FROM {t} WHERE {applies(t, key)})" for t, key in _rules(KEYS)))


def dq_foreign_key() -> str:
    rows = []
    for t, rule in _rules(REFERENCES):
        column, _, target = rule.partition(" references ")
        parent, _, key = target.rstrip(")").partition("(")
        rows.append((t, rule, f"{column} IS NOT NULL", f"{column} NOT IN (SELECT {key} FROM {parent})"))
    # a subquery isn't allowed in a FILTER, so each rule filters and counts in turn
    return _with("\n" + "\nUNION ALL\n".join(
        f"SELECT {_lit(t)} AS table_name, {_lit(rule)} AS rule, (SELECT {_n('COUNT(*)')} FROM {t} WHERE {applies}) AS n_checked, "
        f"(SELECT {_n('COUNT(*)')} FROM {t} WHERE {applies} AND {breaks}) AS n_violations" for t, rule, applies, breaks in rows))


def domain_rules() -> list:
    rows = []
    for t, rule in _rules(ALLOWED):
        column, _, values = rule.partition(" in (")
        allowed = ", ".join(map(_lit, values.rstrip(")").split(", ")))
        rows.append((t, rule, f"{column} IS NOT NULL", f"{column} NOT IN ({allowed})"))
    return rows


def range_rules() -> list:
    return [(t, rule, f"{rule.split()[0]} IS NOT NULL", f"NOT ({rule})") for t, rule in _rules(LIMITS)]


def length_rules() -> list:
    return [(t, rule, f"{rule.split(')')[0][7:]} IS NOT NULL", f"NOT ({rule})") for t, rule in _rules(LENGTHS)]


def fill_rules() -> list:
    return [(t, f"default({rule})", "TRUE", f"{rule.split()[0]} IS NULL") for t, rule in _rules(FILLS)]


def status_rules() -> list:
    return [
        ("orders", "actual_delivery only when delivered", "TRUE", "actual_delivery IS NOT NULL AND order_status <> 'delivered'"),
        ("orders", "delivered has actual_delivery", "TRUE", "actual_delivery IS NULL AND order_status = 'delivered'"),
        ("orders", "cancelled_at only when cancelled", "TRUE", "cancelled_at IS NOT NULL AND order_status <> 'cancelled'"),
        ("orders", "cancelled has cancelled_at", "TRUE", "cancelled_at IS NULL AND order_status = 'cancelled'"),
    ]


def _broken() -> str:
    """``(table_name, broken)`` for every row of every table, with the names of the rules that it breaks."""
    rules = not_null_rules() + domain_rules() + range_rules() + length_rules() + status_rules()
    tables = list(dict.fromkeys(t for t, *_ in rules))
    flags = {t: ", ".join(f"CASE WHEN ({applies}) AND ({breaks}) THEN {_lit(rule)} END" for name, rule, applies, breaks in rules if name == t)
             for t in tables}
    return ",\nchecked AS (\n" + "\nUNION ALL\n".join(
        f"SELECT {_lit(t)} AS table_name, list_filter([{flags[t]}], lambda r: r IS NOT NULL) AS broken FROM {t}" for t in tables) + ")"


def dq_ingest() -> str:
    return _with(_broken() + f"""
SELECT table_name, {_n('COUNT(*) FILTER (WHERE len(broken) = 0)')} AS n_accepted, {_n('COUNT(*) FILTER (WHERE len(broken) > 0)')} AS n_rejected
FROM checked GROUP BY table_name""")


def dq_quarantine() -> str:
    return _with(_broken() + f"""
SELECT table_name, rule, {_n('COUNT(*)')} AS n_rows, {_n('COUNT(*) FILTER (WHERE n = 1)')} AS n_only_this
FROM (SELECT table_name, len(broken) AS n, unnest(broken) AS rule FROM checked) GROUP BY ALL""")


def sketch_active_accounts() -> str:
    grains = ["month", "quarter", "year"]
    parts = [f"SELECT account_id, account_tier, '{g}' AS grain, CAST(date_trunc('{g}', placed_at) AS DATE) AS period FROM sold" for g in grains]
    parts.append("SELECT account_id, account_tier, 'lifetime', NULL FROM sold")
    return _with(f""",
sold AS (SELECT * FROM orders JOIN corporate_accounts USING (account_id) WHERE order_status = 'delivered')
SELECT account_tier, grain, period, {_n('COUNT(DISTINCT account_id)')} AS accounts, TRUE AS within_bound
FROM ({" UNION ALL ".join(parts)}) GROUP BY ALL""")


def sketch_order_values() -> str:
    return _with(f"""
SELECT account_tier, quantile, {_n('COUNT(*)')} AS n, TRUE AS within_bound
FROM orders JOIN corporate_accounts USING (account_id), (SELECT CAST(unnest([0.25, 0.5, 0.75, 0.9]) AS DOUBLE) AS quantile)
WHERE order_status = 'delivered' AND order_total_usd IS NOT NULL GROUP BY ALL""")


ORACLE: dict[str, str] = {
    "q1a_caterer_scorecard": q1a(),
    "q1b_monthly_otd_trend": q1b(),
    "q1c_caterer_tier": q1c(),
    "q2a_monthly_gmv_growth": q2a(),
    "q2b_revenue_pareto": q2b(),
    "q2c_gmv_by_tier_quarter": q2c(),
    "q3a_order_cadence": q3a(),
    "q3b_cohort_retention": q3b(),
    "q3c_churn_risk": q3c(),
    "q4a_promo_vs_nonpromo": q4a(),
    "q4b_campaign_roi": q4b(),
    "q4c_first_order_promo": q4c(),
    "q5a1_experiment_enrollment": q5a1(),
    "q5a2_experiment_results": q5a2(),
    "q5b1_conversion_by_variant": q5b1(),
    "q5b2_gmv_by_variant": q5b2(),
    "q5c1_results_by_tier": q5c1(),
    "q5c2_power_users": q5c2(),
    "q5c3_account_age": q5c3(),
    "q5d_srm_check": q5d(),
    "q5e_cancellation_guardrail": q5e(),
    "experiment_read_out": experiment_read_out(),
    "q6a_signup_funnel": q6a(),
    "q6b_ltv_by_cohort": q6b(),
    "q6c_top_accounts_churn": q6c(),
    "dq_not_null": _report(not_null_rules()),
    "dq_unique_key": dq_unique_key(),
    "dq_foreign_key": dq_foreign_key(),
    "dq_domain": _report(domain_rules()),
    "dq_range": _report(range_rules()),
    "dq_length": _report(length_rules()),
    "dq_default_fill": _report(fill_rules()),
    "dq_status_timestamps": _report(status_rules()),
    "dq_table_rules": _report(not_null_rules() + domain_rules() + range_rules() + length_rules() + fill_rules() + status_rules()),
    # from stored roll-ups and buckets: the reports they stand for
    "rollup_monthly_gmv_growth": q2a(),
    "rollup_gmv_by_tier_quarter": q2c(),
    "rollup_order_cadence": q3a(),
    "rollup_cohort_retention": q3b(),
    "rollup_churn_risk": q3c(),
    "rollup_ltv_by_cohort": q6b(),
    "bucketed_churn_risk": q3c(),
    "bucketed_ltv_by_cohort": q6b(),
    "bucketed_top_accounts": q6c(),
    "dq_ingest": dq_ingest(),
    "dq_quarantine": dq_quarantine(),
    "sketch_active_accounts": sketch_active_accounts(),
    "sketch_order_values": sketch_order_values(),
}
