"""Bucketed roll-up, quarantining ingest, and sketches: plans, round trips, error bounds."""

import datetime as dt
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from platewise import sources
from platewise.operators import quality, rollup, sketches
from platewise.plans import params as P
from platewise.plans import stored
from platewise.plans.inspect import plan_text, scan_counts
from platewise.sources import buckets, ingest, schemas
from tests.conftest import SF_MEDIUM, SF_SMALL


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/t"


# --- buckets -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def bucketed(spark):
    m = sources.load(spark, SF_SMALL, "test")
    days = rollup.account_days(m.orders)
    path = folder()
    rollup.write_bucketed(m.corporate_accounts, days.withColumn("version", F.lit(0)).withColumn("period", F.lit(None).cast("date")), path, 4)
    return path


REPORTS = {
    "3C": lambda a, d: rollup.churn_risk(a, d, P.ANALYSIS_DATE),
    "6B": rollup.ltv_by_cohort,
    "6C": lambda a, d: rollup.top_accounts_churn(a, d, P.ANALYSIS_DATE),
}


@pytest.mark.parametrize("report", REPORTS)
def test_no_shuffle_by_account(spark, bucketed, report):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # else a small side hides the question
    try:
        a, d = rollup.read_bucketed(spark, bucketed)
        text = plan_text(REPORTS[report](a, d), "simple")
        m = sources.load(spark, SF_SMALL, "test")
        plain = plan_text(REPORTS[report](m.corporate_accounts, rollup.account_days(m.orders)), "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning(account_id" in plain
    assert "hashpartitioning(account_id" not in text and text.count("Bucketed: true") == 2


def test_another_session_finds_the_buckets(spark, bucketed):
    before = sorted(map(tuple, buckets.read(spark, f"{bucketed}/accounts").collect()))
    spark.sql(f"DROP TABLE {buckets.table_name(bucketed + '/accounts')}")  # external: only the catalog forgets it
    again = buckets.read(spark, f"{bucketed}/accounts")
    assert sorted(map(tuple, again.collect())) == before
    assert "Bucketed: true" in plan_text(again.groupBy("account_id").count(), "simple")


def test_one_hot_account_is_a_row_a_day(spark):
    orders = sources.load(spark, SF_SMALL, "test").orders
    hot = orders.withColumn("account_id", F.when(F.col("order_id") % 3 == 0, 1).otherwise(F.col("account_id")))
    days = rollup.account_days(hot)
    largest = days.groupBy("account_id").count().agg(F.max("count")).first()[0]
    assert largest <= hot.select(F.to_date("placed_at")).distinct().count()


# --- ingest --------------------------------------------------------------------------------------

def test_accepted_and_rejected_are_the_input(spark):
    tables = sources.load(spark, SF_SMALL, "test").as_dict()
    expected = {(r["table_name"], r["rule"]): (r["n_checked"], r["n_violations"]) for r in quality.table_rules_check(tables).collect()}
    path, got, rejected = folder(), {}, 0
    for name, df in tables.items():
        counts = ingest.ingest(df, name, path, "0")
        got |= {(t, rule): (c, v) for t, rule, c, v in counts["rules"]}
        rejected += counts["n_rejected"]
        ok, bad = ingest.accepted(spark, path, name), ingest.quarantine(spark, path, name)
        assert (ok.count(), bad.count()) == (counts["n_accepted"], counts["n_rejected"])
        both = ok.unionByName(bad.drop(ingest.BROKEN, "batch"))
        assert both.exceptAll(df.select(both.columns)).isEmpty() and df.count() == counts["n_rows"] == both.count()
    assert rejected > 0
    assert got == {k: v for k, v in expected.items() if not k[1].startswith("default(")}


def test_one_scan(spark):
    path = folder()
    sources.write_canonical(sources.load(spark, SF_SMALL, "test"), path)
    orders = sources.load(spark, path).orders
    assert scan_counts(ingest.flagged(orders, "orders")) == {"orders": 1}


def test_broken_rules_defaults_and_replay(spark):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.CATERERS.fields)
    row = lambda i, rating, reviews, name="ok", state="NY": (i, name, "Town", state, None, rating, reviews, None, True)
    rows = [row(1, Decimal(3), 4), row(2, Decimal("9.50"), None, "x" * 121, "NYC"), row(3, None, None)]
    rows = [(*r[:7], dt.date(2024, 1, 1), r[8]) for r in rows]
    path = folder()
    df = spark.createDataFrame(rows, schema).withColumn("sink", F.lit("clash"))
    for _ in range(2):  # the same batch again replaces itself
        counts = ingest.ingest(df, "caterers", path, "0")
        assert (counts["n_rows"], counts["n_accepted"], counts["n_rejected"]) == (3, 1, 2)
    bad = {r["caterer_id"]: r[ingest.BROKEN] for r in ingest.quarantine(spark, path, "caterers").collect()}
    assert bad == {2: ["not_null(total_reviews)", "avg_rating BETWEEN 1.0 AND 5.0", "length(caterer_name) <= 120", "length(state_code) <= 2"],
                   3: ["not_null(total_reviews)"]}
    counts = ingest.ingest(df, "caterers", path, "1", fill_defaults=True)
    assert (counts["n_accepted"], counts["n_rejected"]) == (2, 1)
    assert ingest.accepted(spark, path, "caterers").count() == 3
    report = {r["rule"]: (r["n_rows"], r["n_only_this"]) for r in ingest.quarantine_report(spark, path, ["caterers"]).collect()}
    assert report["not_null(total_reviews)"] == (2, 1)


def test_empty_batch(spark):
    path = folder()
    counts = ingest.ingest(spark.createDataFrame([], schemas.CATERERS), "caterers", path, "0")
    assert (counts["n_rows"], counts["n_rejected"]) == (0, 0)
    assert ingest.accepted(spark, path, "caterers").count() == 0


def test_ingest_keeps_both_sinks_open(spark, monkeypatch):
    """Else every task sorts its rows by sink, all of them in memory."""
    seen, write = [], DataFrameWriter.parquet

    def recorded(self, *args, **named):
        seen.append(spark.conf.get(ingest.WRITERS))
        return write(self, *args, **named)

    rows = sources.load(spark, SF_SMALL, "test").delivery_events
    rows = rows.withColumn("event_type", F.when(F.col("event_id") % 7 == 0, F.lit("lost")).otherwise(F.col("event_type")))
    old, path = spark.conf.get(ingest.WRITERS), folder()
    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    got = ingest.ingest(rows, "delivery_events", path, "0")
    assert seen == ["2"] and spark.conf.get(ingest.WRITERS) == old
    kept, out = ingest.accepted(spark, path, "delivery_events"), ingest.quarantine(spark, path, "delivery_events")
    assert got["n_accepted"] == kept.count() > 0 and got["n_rejected"] == out.count() > 0
    assert sorted(map(str, kept.collect() + out.drop(ingest.BROKEN, "batch").collect())) == sorted(map(str, rows.collect()))
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest.ingest(rows, "delivery_events", path, "1")
    assert spark.conf.get(ingest.WRITERS) == old


# --- sketches ------------------------------------------------------------------------------------

def test_sketches_within_their_bounds(spark):
    for query in (stored.sketch_active_accounts, stored.sketch_order_values):
        assert {r["within_bound"] for r in query(spark, SF_MEDIUM).select("within_bound").collect()} == {True}


def test_distinct_counts_far_above_the_exact_range(spark):
    """A sketch is exact while it is small; 300,000 ids are not."""
    accounts = spark.range(300_000).select(F.col("id").alias("account_id"), F.lit("smb").alias("account_tier"))
    orders = accounts.select("account_id", F.lit("delivered").alias("order_status"),
                             F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(account_id % 360 as int))").alias("placed_at"))
    monthly = sketches.active_accounts_sketches(accounts, orders)
    got = sketches.active_accounts(monthly, "lifetime").first()["active_accounts"]
    assert 0 < abs(got - 300_000) <= 300_000 * sketches.hll_error()
    exact = {r["q"]: r["count"] for r in orders.groupBy(F.trunc(F.to_date("placed_at"), "quarter").alias("q")).count().collect()}
    quarters = {r["period"]: r["active_accounts"] for r in sketches.active_accounts(monthly, "quarter").collect()}
    assert quarters.keys() == exact.keys() and all(abs(quarters[q] - n) <= n * sketches.hll_error() for q, n in exact.items())


def test_coarser_grains_scan_the_sketches_only(spark):
    m, path = sources.load(spark, SF_SMALL, "test"), folder()
    sketches.active_accounts_sketches(m.corporate_accounts, m.orders).write.parquet(path)
    assert set(scan_counts(sketches.active_accounts(spark.read.parquet(path), "year"))) == {"t"}


def test_merged_quantiles_equal_the_whole_within_the_bound(spark):
    k = 200
    values = spark.range(100_000).select((F.col("id") * 7919 % 100_000).cast("double").alias("v"), (F.col("id") % 37).alias("part"))
    parts = values.groupBy("part").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("v", k).alias("values"))
    got = sketches.order_value_quantiles(parts, [], (0.1, 0.5, 0.99), k).first()
    for q in (0.1, 0.5, 0.99):  # the value is its own rank here
        assert abs(got[f"p{round(100 * q)}"] / 100_000 - q) <= sketches.kll_error(k)
