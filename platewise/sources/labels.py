"""Report labels the analytics emit.

Fixed values: the label texts of the source queries, kept verbatim (including
the en dash and the warning sign), grouped by the report that emits them.
"""

# caterer tier badge by quartile (4 = best)
TIER_LABELS = {4: "Platinum", 3: "Gold", 2: "Silver", 1: "Needs Improvement"}
# revenue concentration segment; the threshold is a parameter (80 by default)
PARETO_TOP = "Top {threshold}% GMV"
PARETO_TAIL = "Long Tail"
# churn risk tiers, in priority order
CHURN_LABELS = ("High Risk", "Medium Risk", "Active")
# promo order types
PROMO = "Promo"
NON_PROMO = "Non-Promo"
# campaign ROI assessment
ROI_LABELS = ("ROI Positive", "Free Delivery (No Discount Cost)", "ROI Negative")
# experiment segment cuts
POWER_USER = "Power User"
REGULAR_USER = "Regular User"
AGE_LABELS = ("New Account (< 60 days)", "Growing Account (60–180 days)", "Established Account (180+ days)")
# sample-ratio-mismatch status
SRM_LABELS = ("⚠ SRM DETECTED", "OK")
# top accounts churn signal
CHURN_SIGNALS = ("AT RISK", "HEALTHY")
