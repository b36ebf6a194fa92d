"""Parquet tables partitioned by period, updated by key.

An update rewrites only the partitions whose rows it changes, by dynamic
partition overwrite; the files of all others stay as they are.  What the touched
partitions will hold is written first, next to the table and under the name of
the batch: a job that dies while it replaces partitions is finished by running
the batch again, and running a finished batch again changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERIOD = "period"


def period_of(ts: str, unit: str = "day"):
    """First day of the ``unit`` (day, month, quarter, year) that holds a timestamp or date."""
    return F.to_date(ts) if unit == "day" else F.trunc(F.to_date(ts), unit)


def _path(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def folder(path: str, period) -> str:
    """The folder of one partition."""
    return f"{path}/{PERIOD}={'__HIVE_DEFAULT_PARTITION__' if period is None else period}"


def with_period(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(PERIOD, T.DateType())])


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def overwrite_periods(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Replace the partitions for which ``df`` has rows; rows are clustered by period and ``order``.

    Ranges, not hashes, so that a period with very many rows is written by many tasks.
    """
    write_periods(df.repartitionByRange(PERIOD, *order), path, order)


def write_periods(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """:func:`overwrite_periods` for rows that are in ranges of period and ``order`` already."""
    (df.sortWithinPartitions(PERIOD, *order)
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD).parquet(path))


def touched_periods(df: DataFrame) -> list:
    """The distinct periods of ``df``: at most the calendar's days."""
    return [r[0] for r in df.select(PERIOD).distinct().collect()]


def in_periods(values: list):
    """Predicate for rows of these periods, which prunes partitions."""
    known = [v for v in values if v is not None]
    return F.col(PERIOD).isin(known) | (F.col(PERIOD).isNull() if len(known) < len(values) else F.lit(False))


def upsert(spark: SparkSession, path: str, changes: DataFrame, key: Sequence[str], batch: str, moves: bool = False,
           delete_when: str | None = None) -> list:
    """Insert the rows of ``changes``, in place of stored rows with the same key; returns the periods it rewrote.

    ``changes`` has the table's columns and ``period``; a key may occur there
    once only (else ``ValueError``), and its parts must not be null.  ``moves``: the period of a key may
    change, so the keys of all partitions are searched; else an old row is
    looked for in the periods of the changes only.  ``delete_when`` is a
    predicate on ``changes`` for rows that only remove the stored one.

    The partitions' new content goes to ``<path>__pending/<batch>`` first.
    Running the batch again finishes an interrupted one, and repeats a finished
    one to the same rows.
    """
    pending = f"{path}__pending/{batch}"
    if not exists(spark, f"{pending}/content/_SUCCESS"):
        delete(spark, pending)
        changes.write.parquet(f"{pending}/changes")
        changes = read(spark, f"{pending}/changes", changes.schema)
        broken = changes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(
            (F.col("n") > 1) | F.greatest(*[F.col(k).isNull() for k in key], F.lit(False)))
        if broken.head(1):
            delete(spark, pending)
            raise ValueError(f"{batch}: a key of {list(key)} is null or occurs more than once in the changes")
        keys = changes.select(*key)
        new = changes.filter(f"NOT coalesce({delete_when}, false)") if delete_when else changes
        periods = touched_periods(changes)
        content = new
        if exists(spark, path):
            stored = read(spark, path, changes.schema)
            if moves:
                periods = sorted({*periods, *touched_periods(stored.select(*key, PERIOD).join(keys, list(key), "left_semi"))}, key=str)
            content = stored.filter(in_periods(periods)).join(keys, list(key), "left_anti").select(*changes.columns).unionByName(new)
        spark.createDataFrame([(p,) for p in periods], f"{PERIOD} date").write.parquet(f"{pending}/periods")
        content.write.parquet(f"{pending}/content")
    content = read(spark, f"{pending}/content", changes.schema)
    periods = touched_periods(read(spark, f"{pending}/periods"))
    left = touched_periods(content)
    if left:
        overwrite_periods(content, path, list(key))
    for gone in set(periods).difference(left):
        delete(spark, folder(path, gone))
    delete(spark, pending)
    return sorted(periods, key=str)
