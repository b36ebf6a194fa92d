"""Ingest that keeps rows which break a rule of the schema out of the table.

Every row gets the list of the single-row rules it breaks; one job writes the
table's rows to ``accepted`` and the others, with their rules, to
``quarantine``, and counts both and every rule on the way (``Observation``), so
the input is read once.  Corrected rows of the quarantine go through
the same door again.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from . import schemas

BROKEN = "broken_rules"
ACCEPTED, QUARANTINE = "accepted", "quarantine"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
COUNTS = "table_name string, rule string, n_checked long, n_violations long"


def rejecting_rules(table: str) -> list[tuple[str, Column, Column]]:
    """The rules of ``table`` that keep a row out: all single-row rules but the DEFAULTs, which only fill."""
    return [check for check in quality.table_checks(table) if not check[0].startswith("default(")]


def flagged(df: DataFrame, table: str) -> DataFrame:
    """``df`` with ``broken_rules``, the names of the rules that a row breaks, in the order of the rules."""
    names = F.array(*[F.when(F.coalesce(violated, F.lit(False)), F.lit(rule)) for rule, _, violated in rejecting_rules(table)])
    return df.withColumn(BROKEN, F.array_compact(names))


@contextlib.contextmanager
def _open_writers(spark: SparkSession, count: int):
    """A task of a partitioned write keeps a file open for each of ``count`` partitions.

    Else it sorts all its rows by partition first, and holds them for that.
    """
    old = spark.conf.get(WRITERS, None)
    spark.conf.set(WRITERS, str(count))
    try:
        yield
    finally:
        spark.conf.unset(WRITERS) if old is None else spark.conf.set(WRITERS, old)


def ingest(df: DataFrame, table: str, path: str, batch: str, fill_defaults: bool = False) -> dict:
    """Write a batch of ``table`` to ``path`` and return its counts.

    The result has ``n_rows``, ``n_accepted``, ``n_rejected`` and ``rules``, rows
    ``(table_name, rule, n_checked, n_violations)``.  With ``fill_defaults``
    NULLs of columns with a DEFAULT are filled before the rules are checked.  A batch that is run
    again replaces what it wrote before.  The columns are those of the schema; others are dropped.
    """
    rows = df.select([f.name for f in schemas.SCHEMAS[table].fields])
    rows = flagged(quality.apply_defaults(rows, table) if fill_defaults else rows, table)
    rules, seen = rejecting_rules(table), Observation()
    counts = [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size(BROKEN) > 0).alias("n_rejected")]
    for i, (_, checked, violated) in enumerate(rules):
        counts += [F.count_if(checked).alias(f"c{i}"), F.count_if(violated).alias(f"v{i}")]
    sinks = rows.observe(seen, *counts).withColumn("sink", F.when(F.size(BROKEN) > 0, F.lit(QUARANTINE)).otherwise(F.lit(ACCEPTED)))
    with _open_writers(df.sparkSession, 2):
        sinks.write.mode("overwrite").partitionBy("sink").parquet(f"{path}/{table}/batch={batch}")
    got = seen.get
    return {"n_rows": got["n_rows"], "n_accepted": got["n_rows"] - got["n_rejected"], "n_rejected": got["n_rejected"],
            "rules": [(table, rule, got[f"c{i}"], got[f"v{i}"]) for i, (rule, _, _) in enumerate(rules)]}


def _sink(spark: SparkSession, path: str, table: str, sink: str) -> DataFrame:
    schema = schemas.SCHEMAS[table]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    stored = spark.read.schema(f"{columns}, {BROKEN} array<string>, batch string, sink string").parquet(f"{path}/{table}")
    return stored.filter(F.col("sink") == sink).drop("sink")


def accepted(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The table: rows of all batches that break no rule."""
    return _sink(spark, path, table, ACCEPTED).drop(BROKEN, "batch")


def quarantine(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows that were kept out, with ``broken_rules`` and the ``batch`` they came in."""
    return _sink(spark, path, table, QUARANTINE)


def quarantine_report(spark: SparkSession, path: str, tables: list[str]) -> DataFrame:
    """Per table and broken rule the rows in quarantine: those that break it, and those that break it alone."""
    parts = [quarantine(spark, path, t).select(F.lit(t).alias("table_name"), F.explode(BROKEN).alias("rule"), F.size(BROKEN).alias("n"))
             for t in tables]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("table_name", "rule").agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"), F.count_if(F.col("n") == 1).cast("long").alias("n_only_this"))
