"""Data-quality checks: the schema's constraints as batch Spark jobs.

Spark does not enforce NOT NULL, keys, CHECKs or enum domains on parquet, so
each constraint kind is one parametric operator.  Every operator returns a
summary with one row per rule::

    table_name string, rule string, n_checked long, n_violations long

and each kind has a ``*_rows`` twin that returns the offending rows.  Rules on
single rows of a table are one aggregation over it, whatever their kinds
(:func:`table_rules_check` runs all of them together); duplicate and orphan
checks aggregate by key first, so a hot key value is one row after partial
aggregation.  NULL passes range, domain, length and UNIQUE checks and is not
an orphan, as in SQL constraints.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import schemas as S

# The constraints declared by the schema.
PRIMARY_KEYS = {
    "corporate_accounts": [("account_id",)],
    "caterers": [("caterer_id",)],
    "orders": [("order_id",)],
    "order_items": [("order_id", "line_number")],
    "delivery_events": [("event_id",)],
    "promotions": [("promo_id",)],
    "promo_orders": [("promo_id", "order_id")],
}
# Unlike a primary key, a UNIQUE key allows any number of NULLs.
UNIQUE_KEYS = {"promotions": [("promo_code",)]}
FOREIGN_KEYS = [
    ("orders", "account_id", "corporate_accounts", "account_id"),
    ("orders", "caterer_id", "caterers", "caterer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("delivery_events", "order_id", "orders", "order_id"),
    ("promo_orders", "promo_id", "promotions", "promo_id"),
    ("promo_orders", "order_id", "orders", "order_id"),
]
DOMAINS = [
    ("orders", "order_status", S.ORDER_STATUSES),
    ("orders", "delivery_tier", S.DELIVERY_TIERS),
    ("corporate_accounts", "account_tier", S.ACCOUNT_TIERS),
    ("promotions", "target_tier", S.ACCOUNT_TIERS),
    ("promotions", "discount_type", S.DISCOUNT_TYPES),
    ("delivery_events", "event_type", S.EVENT_TYPES),
    ("order_items", "category", S.ITEM_CATEGORIES),
]
# (table, column, SQL predicate that must hold, as text valid in Spark and DuckDB)
RANGES = [
    ("caterers", "avg_rating", "avg_rating BETWEEN 1.0 AND 5.0"),
    ("orders", "headcount", "headcount > 0"),
    ("orders", "order_total_usd", "order_total_usd >= 0"),
    ("order_items", "unit_price_usd", "unit_price_usd >= 0"),
    ("order_items", "quantity", "quantity > 0"),
]
MAX_LENGTHS = {
    "corporate_accounts": {"company_name": 120, "industry": 80, "city": 60, "state_code": 2},
    "caterers": {"caterer_name": 120, "city": 60, "state_code": 2, "cuisine_type": 60},
    "order_items": {"item_name": 120, "category": 60},
    "delivery_events": {"event_type": 40},
    "promotions": {"promo_code": 30, "description": 200, "discount_type": 20},
}
DEFAULTS = {
    "corporate_accounts": {"account_tier": "smb", "is_active": True},
    "caterers": {"total_reviews": 0, "is_active": True},
    "orders": {"order_status": "pending", "delivery_tier": "standard", "delivery_fee_usd": 0, "discount_usd": 0},
}
# (rule name, SQL predicate that flags a violation) on orders
STATUS_TIMESTAMP_RULES = [
    ("actual_delivery only when delivered", "order_status <> 'delivered' AND actual_delivery IS NOT NULL"),
    ("delivered has actual_delivery", "order_status = 'delivered' AND actual_delivery IS NULL"),
    ("cancelled_at only when cancelled", "order_status <> 'cancelled' AND cancelled_at IS NOT NULL"),
    ("cancelled has cancelled_at", "order_status = 'cancelled' AND cancelled_at IS NULL"),
]


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in S.SCHEMAS[table].fields if not f.nullable]


def _one_pass(df: DataFrame, table: str, checks: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """One aggregation over ``df``; ``checks`` are (rule, checked-predicate, violation-predicate)."""
    aggs = []
    for i, (_, checked, violated) in enumerate(checks):
        aggs += [F.count_if(checked).alias(f"c{i}"), F.count_if(violated).alias(f"v{i}")]
    row = df.agg(*aggs)
    entries = [F.struct(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                        F.col(f"c{i}").cast("long").alias("n_checked"),
                        F.col(f"v{i}").cast("long").alias("n_violations"))
               for i, (rule, _, _) in enumerate(checks)]
    return row.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def not_null_checks(columns: Sequence[str]) -> list:
    return [(f"not_null({c})", F.lit(True), F.col(c).isNull()) for c in columns]


def domain_checks(items: Sequence[tuple[str, Sequence[str]]]) -> list:
    return [(f"{col} in ({', '.join(values)})", F.col(col).isNotNull(),
             F.col(col).isNotNull() & ~_in_domain(col, values)) for col, values in items]


def range_checks(items: Sequence[tuple[str, str]]) -> list:
    return [(predicate, F.col(col).isNotNull(), F.col(col).isNotNull() & ~F.expr(predicate))
            for col, predicate in items]


def status_checks(rules=None) -> list:
    return [(name, F.lit(True), F.coalesce(F.expr(pred), F.lit(False)))
            for name, pred in (rules or STATUS_TIMESTAMP_RULES)]


def one_pass(df: DataFrame, table: str, checks: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Any list of single-table checks, evaluated in one aggregation over ``df``."""
    return _one_pass(df, table, checks)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def not_null_check(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """NOT NULL columns (default: the non-nullable fields of the canonical schema)."""
    columns = columns or {t: not_null_columns(t) for t in tables}
    return _union([_one_pass(tables[t], t, not_null_checks(cols)) for t, cols in columns.items() if cols])


def not_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def unique_key_check(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[Sequence[str]]] = PRIMARY_KEYS,
                     unique: Mapping[str, Sequence[Sequence[str]]] = UNIQUE_KEYS) -> DataFrame:
    """Primary and UNIQUE keys: rows whose key value occurs more than once.

    Rows are grouped on the key's own columns.  NULLs are equal values of a
    primary key; a UNIQUE key isn't checked on rows where a part is NULL.
    """
    parts = []
    for kind, strict in ((keys, True), (unique, False)):
        for t, key in ((t, key) for t, key_list in kind.items() for key in key_list if t in tables):
            df = tables[t] if strict else tables[t].dropna(subset=list(key))
            # a global aggregate: one row even for an empty table
            parts.append(df.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).agg(
                F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("n_checked"),
                F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).cast("long").alias("n_violations")).select(
                F.lit(t).alias("table_name"), F.lit(f"unique({', '.join(key)})").alias("rule"), "n_checked", "n_violations"))
    return _union(parts)


def unique_key_rows(df: DataFrame, key: Sequence[str], nulls_equal: bool = True) -> DataFrame:
    """Rows that share their key; with ``nulls_equal=False`` (UNIQUE) rows with a NULL part aren't checked."""
    if not nulls_equal:
        df = df.dropna(subset=list(key))
    dups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > 1) \
        .select(*[F.col(c).alias(f"_d_{c}") for c in key])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_d_{c}")) for c in key])
    return df.join(dups, same, "left_semi")


def foreign_key_check(tables: Mapping[str, DataFrame], fks: Sequence[tuple[str, str, str, str]] = FOREIGN_KEYS
                      ) -> DataFrame:
    """References: non-NULL child values with no parent row.

    All references are met at once.  Each child table is read once: its key
    columns become rows (reference, value), counted before they move, so a hot value is one row after partial
    aggregation.  Each parent is read once, for its keys.  One join
    by (parent, value) decides every reference.  Only numbers of rules, key values and counts move.
    """
    if not fks:
        raise ValueError("no references to check")
    parents = list(dict.fromkeys((parent, pk) for *_, parent, pk in fks))
    types = {tables[t].schema[c].dataType for child, fk, parent, pk in fks for t, c in ((child, fk), (parent, pk))}
    as_key = lambda c: F.col(c) if len(types) == 1 else F.col(c).cast("string")
    children: dict[str, list] = {}
    for ref, (child, fk, parent, pk) in enumerate(fks):
        children.setdefault(child, []).append(F.struct(
            F.lit(ref).alias("ref"), F.lit(parents.index((parent, pk))).alias("parent"), as_key(fk).alias("v")))
    values = _union([tables[child].select(F.explode(F.array(*refs)).alias("r")).select("r.*").filter("v IS NOT NULL")
                     .groupBy("ref", "parent", "v").agg(F.count(F.lit(1)).alias("k")) for child, refs in children.items()])
    keys = _union([tables[parent].select(F.lit(i).alias("of"), as_key(pk).alias("p")) for i, (parent, pk) in enumerate(parents)]).distinct()
    met = values.join(keys, (F.col("parent") == F.col("of")) & (F.col("v") == F.col("p")), "left").groupBy("ref").agg(
        F.sum("k").alias("n"), F.sum(F.when(F.col("p").isNull(), F.col("k"))).alias("lost"))
    names = tables[fks[0][0]].sparkSession.createDataFrame(
        [(i, child, f"{fk} references {parent}({pk})") for i, (child, fk, parent, pk) in enumerate(fks)], "no int, table_name string, rule string")
    return names.join(met, F.col("no") == F.col("ref"), "left").select(
        "table_name", "rule", F.coalesce("n", F.lit(0)).cast("long").alias("n_checked"),
        F.coalesce("lost", F.lit(0)).cast("long").alias("n_violations"))


def foreign_key_rows(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    return child.filter(F.col(fk).isNotNull()).join(
        parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")


def _in_domain(col: str, values: Sequence[str]) -> Column:
    return F.col(col).isin(*values)


def domain_check(tables: Mapping[str, DataFrame], domains=DOMAINS) -> DataFrame:
    """Enum and vocabulary columns: non-NULL values outside the allowed set."""
    by_table: dict[str, list] = {}
    for t, col, values in domains:
        by_table.setdefault(t, []).append((col, values))
    return _union([_one_pass(tables[t], t, domain_checks(items)) for t, items in by_table.items()])


def domain_rows(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    return df.filter(F.col(col).isNotNull() & ~_in_domain(col, values))


def range_check(tables: Mapping[str, DataFrame], ranges=RANGES) -> DataFrame:
    """CHECK constraints: non-NULL values for which the predicate is false."""
    by_table: dict[str, list] = {}
    for t, col, predicate in ranges:
        by_table.setdefault(t, []).append((col, predicate))
    return _union([_one_pass(tables[t], t, range_checks(items)) for t, items in by_table.items()])


def range_rows(df: DataFrame, items: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows that break one of ``(column, predicate)``."""
    return violating_rows(df, range_checks(items))


def length_checks(limits: Mapping[str, int]) -> list:
    return [(f"length({c}) <= {n}", F.col(c).isNotNull(), F.length(c) > n) for c, n in limits.items()]


def length_check(tables: Mapping[str, DataFrame], limits=MAX_LENGTHS) -> DataFrame:
    """VARCHAR(n) / CHAR(n): non-NULL values longer than n characters."""
    return _union([_one_pass(tables[t], t, length_checks(cols)) for t, cols in limits.items()])


def length_rows(df: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Rows with a value longer than its column allows."""
    return violating_rows(df, length_checks(limits))


def apply_defaults(df: DataFrame, table: str, defaults=DEFAULTS) -> DataFrame:
    """Fill the declared DEFAULTs into NULLs (on ingest)."""
    return df.fillna(dict(defaults.get(table, {})))


def default_checks(defaults: Mapping[str, object]) -> list:
    return [(f"default({c} = {v!r})", F.lit(True), F.col(c).isNull()) for c, v in defaults.items()]


def default_fill_check(tables: Mapping[str, DataFrame], defaults=DEFAULTS) -> DataFrame:
    """Per column with a DEFAULT: how many NULLs ``apply_defaults`` fills."""
    return _union([_one_pass(tables[t], t, default_checks(cols)) for t, cols in defaults.items()])


def default_fill_rows(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Rows with a NULL that ``apply_defaults`` fills."""
    return violating_rows(df, default_checks(defaults))


def status_timestamp_check(orders: DataFrame, rules=STATUS_TIMESTAMP_RULES) -> DataFrame:
    """Lifecycle timestamps consistent with the order status."""
    return _one_pass(orders, "orders", status_checks(rules))


def status_timestamp_rows(orders: DataFrame, rules=STATUS_TIMESTAMP_RULES) -> DataFrame:
    """Orders whose lifecycle timestamps contradict their status."""
    return violating_rows(orders, status_checks(rules))


def violating_rows(df: DataFrame, checks: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Rows that break at least one of the checks."""
    broken = [F.coalesce(violated, F.lit(False)) for _, _, violated in checks]
    return df.filter(reduce(lambda a, b: a | b, broken, F.lit(False)))


def table_checks(table: str) -> list:
    """The declared rules of every kind that a single row of ``table`` can break."""
    checks = not_null_checks(not_null_columns(table))
    checks += domain_checks([(c, v) for t, c, v in DOMAINS if t == table])
    checks += range_checks([(c, p) for t, c, p in RANGES if t == table])
    checks += length_checks(MAX_LENGTHS.get(table, {})) + default_checks(DEFAULTS.get(table, {}))
    return checks + (status_checks() if table == "orders" else [])


def table_rules_check(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All single-row rules of all kinds, with one scan of each table."""
    return _union([_one_pass(df, t, table_checks(t)) for t, df in tables.items()])


def fill_cancelled_at(orders: DataFrame, hours: int = 2) -> DataFrame:
    """Derive ``cancelled_at`` for cancelled orders that lack it (``placed_at`` + ``hours``).

    The seed load sets it this way after inserting the orders; other rows keep
    their value.
    """
    derived = F.col("placed_at") + F.make_dt_interval(hours=F.lit(hours))
    return orders.withColumn("cancelled_at", F.when(
        (F.col("order_status") == "cancelled") & F.col("cancelled_at").isNull(), derived
    ).otherwise(F.col("cancelled_at")))
