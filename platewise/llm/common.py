"""Helpers shared by the training-data operators.

Conventions every operator keeps:

* only the columns it needs are read and renamed on entry, so extra columns of
  any name are ignored and cannot clash;
* a null text counts as the empty text; null ids stay null;
* repeated rows are separate rows unless the operator's docstring says otherwise;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with null texts as empty ones."""
    return df.select(df[id_col].cast("long").alias("doc_id"),
                     F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def carried(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """All columns renamed ``c_...``, and the name of the one with the text (null for none).

    A text goes to Python and back once; only one that isn't a string gets a column of its own.
    """
    own = docs.select(*[docs[f"`{c}`"].alias(f"c_{c}") for c in docs.columns])
    if dict(docs.dtypes)[text_col] == "string":
        return own, f"c_{text_col}"
    return own.withColumn("text", F.col(f"`c_{text_col}`").cast("string")), "text"


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch, null ones as empty ones."""
    return [t or "" for t in batch[name].to_pylist()]


#: Most rows and bytes that go to a Python worker at once; Spark's own limits (10,000 rows, 64 MB)
#: let a few long texts fill an executor's memory outside the heap.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1000, 8 << 20


def workers_ready(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))


def map_arrow(df: DataFrame, fn: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package wherever the driver was started, in small batches."""
    spark = df.sparkSession
    workers_ready(spark)
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ROWS_AT_ONCE:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_AT_ONCE)
    return df.mapInArrow(fn, schema)


def slices(batches: Batches, rows: int = 256) -> Batches:
    """The batches in parts of at most ``rows`` rows, which bounds what a worker holds as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def batch(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in types.items()], names=list(types))


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, which all machines share."""
    path = ensure_checkpoint_dir(spark)
    return f"{path.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read back.

    Cuts the lineage: every consumer scans the stored columns it needs, and a
    lost executor costs a re-read.  :func:`drop_staged` removes the files.  The
    shuffles of the write go when it ends, as nothing reads them again; else
    their files stay until the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    cleanup = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if cleanup is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, cleanup)
    return spark.read.schema(df.schema).parquet(path)


def unstaged(df: DataFrame) -> None:
    """Remove the files of a table that :func:`staged` gave, once nothing that reads it is still to run."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {os.path.dirname(file) for file in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Remove what :func:`staged` wrote, once no result that reads it is needed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Stored copy of ``df`` in the order of ``order`` with ``_pos``, the 0-based position of each row,
    and ``_total``, the number of rows.  ``order`` should be a total order.

    Range-partitioned and sorted, so that one frequent value spreads over
    ranges; each row's place in its range is in ``monotonically_increasing_id``
    and the starts of the ranges come from a table with a row for each range.
    """
    ordered = staged(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
                       .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
                       .withColumn("_at", F.monotonically_increasing_id()), name)
    return numbered(ordered, [], "_pos", "_total")


def numbered(ordered: DataFrame, by: list[str], pos: str, total: str) -> DataFrame:
    """Positions and counts in each group of ``by``, whose rows follow each other in the order of ``_at``."""
    from pyspark.sql import Window

    part = F.shiftright(F.col("_at"), 33)
    runs = ordered.groupBy(*by, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*by)
    before = F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*[F.col(c).alias(f"_r_{c}") for c in by], F.col("_part"), F.col("_first"),
                       F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(group).alias(total))
    cond = part == runs["_part"]
    for c in by:
        cond = cond & ordered[c].eqNullSafe(runs[f"_r_{c}"])
    return (ordered.join(runs, cond)
            .withColumn(pos, F.col("_before") + F.col("_at") - F.col("_first"))
            .drop("_part", "_first", "_before", *[f"_r_{c}" for c in by]))


def id_ranges(ids: DataFrame, column: str, parts: int) -> list[int]:
    """Upper bounds that cut the ids into about equal ranges; reads that one column.  At most ``parts`` numbers."""
    got = ids.agg(F.percentile_approx(column, [(i + 1) / parts for i in range(parts - 1)] or [1.0], 100_000)
                   .alias("b")).first()["b"]
    return sorted(set(got or []))


def range_of(value: Column, bounds: list[int]) -> Column:
    """Index of the range of :func:`id_ranges` that holds ``value`` (0 for null): two searches in about sqrt(n) bounds."""
    width = max(1, round(len(bounds) ** 0.5))
    rows = [bounds[at:at + width] for at in range(0, len(bounds), width)]
    array = lambda of: F.array(*of) if of else F.array().cast("array<long>")
    longs = lambda of: array([F.lit(int(b)).cast("long") for b in of])
    below = lambda steps: F.size(F.filter(steps, lambda b: b < value))
    if not rows:
        return F.lit(0)
    coarse = below(longs([row[-1] for row in rows]))
    fine = F.get(F.array(*[longs(row) for row in rows]), coarse)
    return F.when(value.isNull(), 0).otherwise(coarse * width + F.coalesce(below(fine), F.lit(0))).cast("int")
