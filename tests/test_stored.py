"""Stored tables: keyed updates, the roll-up refreshed by batch, and what they leave untouched."""

import datetime as dt
import hashlib
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise import sources
from platewise.operators import ltv, retention, revenue, rollup
from platewise.plans import params as P
from platewise.plans.inspect import plan_text, scan_counts
from platewise.sources import schemas, stored
from tests.conftest import SF_SMALL

ROWS = "id long, v string, period date"
D1, D2, D3 = (dt.date(2024, 1, d) for d in (1, 2, 3))


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/t"


def files(path):
    return {os.path.join(d, f): hashlib.sha256(open(os.path.join(d, f), "rb").read()).hexdigest()
            for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows(spark, path):
    return sorted(tuple(r) for r in stored.read(spark, path).select("id", "v", "period").collect())


@pytest.fixture
def table(spark):
    path = folder()
    stored.upsert(spark, path, spark.createDataFrame([(1, "a", D1), (2, "b", D1), (3, "c", D2), (4, "d", D3)], ROWS), ["id"], "b0")
    return path


def test_update_and_insert(spark, table):
    got = stored.upsert(spark, table, spark.createDataFrame([(2, "B", D1), (5, "e", D3)], ROWS), ["id"], "b1")
    assert got == [D1, D3]
    assert rows(spark, table) == [(1, "a", D1), (2, "B", D1), (3, "c", D2), (4, "d", D3), (5, "e", D3)]


def test_untouched_files_and_replay(spark, table):
    before = files(table)
    change = spark.createDataFrame([(2, "B", D1)], ROWS)
    stored.upsert(spark, table, change, ["id"], "b1")
    after = files(table)
    untouched = {f for f in before if "period=2024-01-01" not in f}
    assert untouched and all(before[f] == after[f] for f in untouched)
    first = rows(spark, table)
    stored.upsert(spark, table, change, ["id"], "b1")
    assert rows(spark, table) == first
    assert all(before[f] == files(table)[f] for f in untouched)


def test_moving_rows_and_emptied_partitions(spark, table):
    got = stored.upsert(spark, table, spark.createDataFrame([(3, "c", D1)], ROWS), ["id"], "b1", moves=True)
    assert got == [D1, D2]
    assert rows(spark, table) == [(1, "a", D1), (2, "b", D1), (3, "c", D1), (4, "d", D3)]
    assert not os.path.exists(f"{table}/period=2024-01-02")


def test_deletes(spark, table):
    stored.upsert(spark, table, spark.createDataFrame([(4, "gone", D3), (1, "A", D1)], ROWS), ["id"], "b1", delete_when="v = 'gone'")
    assert rows(spark, table) == [(1, "A", D1), (2, "b", D1), (3, "c", D2)]


def test_null_period_and_empty_batch(spark, table):
    stored.upsert(spark, table, spark.createDataFrame([(9, "n", None)], ROWS), ["id"], "b1")
    stored.upsert(spark, table, spark.createDataFrame([(9, "N", None)], ROWS), ["id"], "b2")
    assert stored.upsert(spark, table, spark.createDataFrame([], ROWS), ["id"], "b3") == []
    got = stored.read(spark, table).select("id", "v", "period").collect()
    assert [tuple(r) for r in got if r["period"] is None] == [(9, "N", None)] and len(got) == 5


@pytest.mark.parametrize("bad", [[(1, "x", D1), (1, "y", D1)], [(None, "x", D1)]])
def test_bad_keys_change_nothing(spark, table, bad):
    before = files(table)
    with pytest.raises(ValueError, match="b1"):
        stored.upsert(spark, table, spark.createDataFrame(bad, ROWS), ["id"], "b1")
    assert files(table) == before and not os.path.exists(f"{table}__pending/b1")


def test_interrupted_batch_is_finished(spark, table, monkeypatch):
    """A job that dies after a partition was removed, before the new one is there."""
    def dies(df, path, order):
        stored.delete(spark, stored.folder(path, D1))
        raise RuntimeError("executor lost")

    change = spark.createDataFrame([(2, "B", D1)], ROWS)
    monkeypatch.setattr(stored, "overwrite_periods", dies)
    with pytest.raises(RuntimeError):
        stored.upsert(spark, table, change, ["id"], "b1")
    monkeypatch.undo()
    stored.upsert(spark, table, change, ["id"], "b1")
    assert rows(spark, table) == [(1, "a", D1), (2, "B", D1), (3, "c", D2), (4, "d", D3)]


def test_update_of_cancelled_at(spark):
    """The seed's stored update: cancelled orders get their time two hours after the order."""
    path = folder()
    orders = sources.load(spark, SF_SMALL, "test").orders.withColumn("cancelled_at", F.lit(None).cast("timestamp_ntz"))
    rollup.apply_batch(spark, path, orders, 0, "year")
    from platewise.operators import quality

    counts = []
    for _ in range(2):  # the second time nothing is left to fill
        lacking = stored.read(spark, f"{path}/orders").filter("order_status = 'cancelled' AND cancelled_at IS NULL")
        counts.append(lacking.count())
        stored.upsert(spark, f"{path}/orders", quality.fill_cancelled_at(lacking), ["order_id"], "fill")
    n = counts[0]
    assert counts == [n, 0]
    got = stored.read(spark, f"{path}/orders")
    assert n > 0 and got.count() == orders.count()
    assert got.filter("order_status = 'cancelled' AND cancelled_at = placed_at + INTERVAL 2 HOURS").count() == n


# --- roll-up ------------------------------------------------------------------------------------

def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_reports_after_batches_and_a_replay(spark):
    path, m = folder(), sources.load(spark, SF_SMALL, "test")
    a, o = m.corporate_accounts, m.orders
    for version, part in enumerate((0, 1, 2, 1)):
        rollup.apply_batch(spark, path, o.filter(F.col("order_id") % 3 == part), version, "year")
    days = rollup.read_days(spark, path)
    assert days.select("account_id", "order_day").distinct().count() == days.count()
    assert days.agg(F.max("version")).first()[0] == 3
    assert same(rollup.monthly_gmv_growth(days), revenue.monthly_gmv_growth(o))
    assert same(rollup.monthly_gmv_growth(days, calendar=True), revenue.monthly_gmv_growth(o, calendar=True))
    assert same(rollup.gmv_by_tier_quarter(a, days), revenue.gmv_by_tier_quarter(a, o))
    assert same(rollup.order_cadence(a, days, P.ANALYSIS_DATE), retention.order_cadence(a, o, P.ANALYSIS_DATE))
    assert same(rollup.cohort_retention(days), retention.cohort_retention(o))
    assert same(rollup.churn_risk(a, days, P.ANALYSIS_DATE), retention.churn_risk(a, o, P.ANALYSIS_DATE))
    assert same(rollup.ltv_by_cohort(a, days), ltv.ltv_by_cohort(a, o))


def order(i, account, day, status="delivered", total=10):
    placed = dt.datetime(2024, 1, day, 12)
    return (i, account, 1, status, "standard", 5, Decimal(total), Decimal(0), Decimal(1), placed, placed, None, None)


def test_late_and_changed_orders_refresh_their_day_only(spark):
    path = folder()
    batch = lambda *orders: spark.createDataFrame(list(orders), schemas.ORDERS)
    rollup.apply_batch(spark, path, batch(order(1, 7, 1), order(2, 7, 2), order(3, 8, 3)), 0)
    before = files(f"{path}/account_days")
    assert rollup.apply_batch(spark, path, batch(order(2, 7, 2, "cancelled"), order(4, 9, 2, total=3)), 1) == [D2]
    after = files(f"{path}/account_days")
    assert {f for f in before if "period=2024-01-02" not in f} <= set(after)
    got = {(r["account_id"], r["order_day"].day): (r["n_live"], r["n_delivered"], r["gmv_delivered"], r["version"])
           for r in rollup.read_days(spark, path).collect()}
    assert got == {(7, 1): (1, 1, 10, 0), (7, 2): (0, 0, None, 1), (8, 3): (1, 1, 10, 0), (9, 2): (1, 1, 3, 1)}
    # all orders of a day go: so does its roll-up
    rollup.apply_batch(spark, path, batch(order(3, 8, 3, "gone")), 2, delete_when="order_status = 'gone'")
    assert {r["order_day"].day for r in rollup.read_days(spark, path).collect()} == {1, 2}


def test_refresh_reads_orders_once_and_touched_partitions_only(spark):
    path = folder()
    rollup.apply_batch(spark, path, sources.load(spark, SF_SMALL, "test").orders, 0, "year")
    plan = rollup.refreshed(spark, path, [dt.date(1996, 1, 1)], 1, "year")
    assert scan_counts(plan)["orders"] == 1
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in text or "PartitionFilters: [(period" in text, text


def test_refresh_moves_orders_once_into_tasks_of_bounded_size(spark, monkeypatch):
    """Its tasks grow in number with the orders, and the wide sums aren't shuffled; null keys and a hot day stay exact."""
    path, hot = folder(), [order(i, 7, 1, total=i)[:9] + (dt.datetime(2024, 1, 1, i % 5),) + order(i, 7, 1)[10:] for i in range(60)]
    odd = [(100, None, *order(100, 1, 2)[2:]), (101, 8, *order(101, 8, 2)[2:9], None, *order(101, 8, 2)[10:]),
           (102, 8, 1, None, *order(102, 8, 3)[4:]), *[order(200 + i, i, i % 28 + 1, "cancelled" if i % 3 else "delivered") for i in range(90)]]
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schemas.ORDERS.fields])
    orders = spark.createDataFrame(hot + odd, nullable)
    monkeypatch.setattr(rollup, "ORDERS_PER_TASK", 10)
    rollup.apply_batch(spark, path, orders, 0, "month")
    plan = rollup.refreshed(spark, path, [dt.date(2024, 1, 1), None], 0, "month")
    assert plan_text(plan, "simple").count("Exchange") == 1
    assert plan.rdd.getNumPartitions() == 16  # 153 orders
    days = rollup.read_days(spark, path)
    assert same(days.select("account_id", "order_day", *rollup.SUMS), rollup.account_days(orders))
    assert {r["stamps_live"] for r in days.filter("account_id = 7 AND n_live > 50").collect()} == {5}
