"""The streaming monitor applies the batch checks to each micro-batch of arriving files."""

import tempfile
from datetime import datetime as ts
from decimal import Decimal as D

from pyspark.sql import functions as F

from platewise.streaming import start_order_quality_monitor
from tests.test_semantics import orders


def test_monitor_reports_each_batch(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    src, out, ckpt = f"{root}/in", f"{root}/report", f"{root}/ckpt"
    orders(spark, dict(), dict(headcount=0)).write.parquet(f"{src}/part1")
    orders(spark, dict(order_status="cancelled", placed_at=ts(2024, 2, 1), order_total_usd=D("5.00"))) \
        .write.parquet(f"{src}/part2")
    q = start_order_quality_monitor(spark, f"{src}/*", out, ckpt, available_now=True, max_files_per_trigger=1)
    q.awaitTermination(120)
    report = spark.read.parquet(out)
    totals = {r.rule: (r.c, r.v) for r in report.groupBy("rule").agg(
        F.sum("n_checked").alias("c"), F.sum("n_violations").alias("v")).collect()}
    assert totals["headcount > 0"] == (3, 1)
    assert totals["cancelled has cancelled_at"] == (3, 1)
    assert report.select("batch_id").distinct().count() >= 2


def test_monitor_resumes_after_restart(spark):
    """A restarted monitor (same checkpoint) only processes files that arrived since."""
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    src, out, ckpt = f"{root}/in", f"{root}/report", f"{root}/ckpt"
    orders(spark, dict()).write.parquet(f"{src}/part1")
    start_order_quality_monitor(spark, f"{src}/*", out, ckpt, available_now=True).awaitTermination(120)
    first = spark.read.parquet(out).select("batch_id").distinct().count()
    orders(spark, dict(headcount=0)).write.parquet(f"{src}/part2")
    start_order_quality_monitor(spark, f"{src}/*", out, ckpt, available_now=True).awaitTermination(120)
    report = spark.read.parquet(out)
    checked = {r.rule: r.c for r in report.groupBy("rule").agg(F.sum("n_checked").alias("c")).collect()}
    assert checked["headcount > 0"] == 2          # each file counted once across both runs
    assert report.select("batch_id").distinct().count() == first + 1


def test_a_batch_run_again_counts_once(spark):
    """After a crash between a batch's report and its commit the batch runs again and replaces its own rows."""
    import glob
    import os

    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    src, out, ckpt = f"{root}/in", f"{root}/report", f"{root}/ckpt"
    orders(spark, dict(), dict(headcount=0)).write.parquet(f"{src}/part1")
    start_order_quality_monitor(spark, f"{src}/*", out, ckpt, available_now=True).awaitTermination(120)
    before = sorted(map(tuple, spark.read.parquet(out).collect()))
    for commit in [*glob.glob(f"{ckpt}/commits/[0-9]*"), *glob.glob(f"{ckpt}/commits/.[0-9]*")]:
        os.unlink(commit)  # the commits of this test's own stream
    start_order_quality_monitor(spark, f"{src}/*", out, ckpt, available_now=True).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == before
