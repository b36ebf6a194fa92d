"""Canonical marketplace schema: table layouts, domains and ordinals.

Timestamps are ``TIMESTAMP_NTZ`` (wall-clock UTC values), so day and month
boundaries never depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The enum members of the schema, in declaration order (the order
# is the sort order of the ordered enums), and the commented vocabularies.
ORDER_STATUSES = ("pending", "confirmed", "in_transit", "delivered", "cancelled")
DELIVERY_TIERS = ("standard", "express", "scheduled")
ACCOUNT_TIERS = ("smb", "mid_market", "enterprise")
EVENT_TYPES = ("dispatched", "arrived", "completed", "failed")
ITEM_CATEGORIES = ("Entree", "Side", "Beverage", "Dessert")
DISCOUNT_TYPES = ("flat", "percent", "free_delivery")
VARIANTS = ("control", "treatment")

_L = T.LongType()
_I = T.IntegerType()
_S = T.StringType()
_D = T.DateType()
_TS = T.TimestampNTZType()
_B = T.BooleanType()


def _schema(*fields):
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in fields])


CORPORATE_ACCOUNTS = _schema(
    ("account_id", _L, False), ("company_name", _S, False), ("industry", _S, True),
    ("account_tier", _S, False), ("city", _S, False), ("state_code", _S, False),
    ("created_at", _D, False), ("is_active", _B, False),
)
CATERERS = _schema(
    ("caterer_id", _L, False), ("caterer_name", _S, False), ("city", _S, False),
    ("state_code", _S, False), ("cuisine_type", _S, True), ("avg_rating", T.DecimalType(3, 2), True),
    ("total_reviews", _I, False), ("onboarded_at", _D, False), ("is_active", _B, False),
)
ORDERS = _schema(
    ("order_id", _L, False), ("account_id", _L, False), ("caterer_id", _L, False),
    ("order_status", _S, False), ("delivery_tier", _S, False), ("headcount", _I, False),
    ("order_total_usd", T.DecimalType(10, 2), False), ("delivery_fee_usd", T.DecimalType(8, 2), False),
    ("discount_usd", T.DecimalType(10, 2), False), ("placed_at", _TS, False),
    ("scheduled_delivery", _TS, False), ("actual_delivery", _TS, True), ("cancelled_at", _TS, True),
)
ORDER_ITEMS = _schema(
    ("order_id", _L, False), ("line_number", _I, False), ("item_name", _S, False),
    ("category", _S, True), ("unit_price_usd", T.DecimalType(10, 2), False), ("quantity", _I, False),
)
DELIVERY_EVENTS = _schema(
    ("event_id", _L, False), ("order_id", _L, False), ("event_type", _S, False),
    ("event_ts", _TS, False), ("notes", _S, True),
)
PROMOTIONS = _schema(
    ("promo_id", _L, False), ("promo_code", _S, False), ("description", _S, True),
    ("discount_type", _S, False), ("discount_value", T.DecimalType(8, 2), False),
    ("start_date", _D, False), ("end_date", _D, False), ("target_tier", _S, True),
)
PROMO_ORDERS = _schema(("promo_id", _L, False), ("order_id", _L, False))
EXPERIMENT_ASSIGNMENTS = _schema(
    ("assignment_id", _L, False), ("account_id", _L, False), ("experiment_name", _S, False),
    ("variant", _S, False), ("assigned_at", _TS, False),
)

SCHEMAS: dict[str, T.StructType] = {
    "corporate_accounts": CORPORATE_ACCOUNTS,
    "caterers": CATERERS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "delivery_events": DELIVERY_EVENTS,
    "promotions": PROMOTIONS,
    "promo_orders": PROMO_ORDERS,
    "experiment_assignments": EXPERIMENT_ASSIGNMENTS,
}
