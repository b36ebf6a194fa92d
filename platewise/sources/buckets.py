"""Tables bucketed on a key, so that joins and aggregations on it need no shuffle.

Tables with the same key and number of buckets meet bucket by bucket.  Spark
knows buckets through its catalog; a table's name there follows from its path,
and a session that hasn't met the table registers it from what is stored
beside it (``<path>__layout``: key, buckets, order and schema).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LAYOUT = "key string, buckets int, sorted array<string>, schema string"


def table_name(path: str) -> str:
    return f"bucketed_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:24]}"


def write(df: DataFrame, path: str, key: str, count: int, order: Sequence[str] = ()) -> None:
    """Store ``df`` in ``count`` buckets by ``key``, one file each, sorted by key and ``order``."""
    spark = df.sparkSession
    (df.repartition(count, key).sortWithinPartitions(key, *order)
       .write.format("parquet").bucketBy(count, key).sortBy(key, *order).mode("overwrite").option("path", path).saveAsTable(table_name(path)))
    spark.createDataFrame([(key, count, [key, *order], df.schema.json())], LAYOUT).coalesce(1).write.mode("overwrite").parquet(f"{path}__layout")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table stored under ``path``, with its buckets."""
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        layout = spark.read.schema(LAYOUT).parquet(f"{path}__layout").first()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(layout["schema"])).fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({layout['key']}) "
                  f"SORTED BY ({', '.join(layout['sorted'])}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)
