"""Sharding by proportional stratified interleaving.

The rows of each source are put in a seeded random order; a row's fractional
rank is its place there divided by the source's size.  All rows sorted by
fractional rank interleave the sources in proportion, so a cut into equal runs
gives every shard the mixture of the whole.

DataFrame functions only.  Two range sorts over narrow rows (no text) replace
a window for each source and a global window: a source with a third of all
rows spreads over many ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 0, id_col: str = "doc_id",
                    text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, text_crc32, shard, slot`` for every row.

    Row counts of shards differ by one at most, and so does each source's
    count in a shard from its share up to the rounding of the cut.  ``slot``
    numbers a shard's rows from 0 in interleaved order.

    Null text: size 1 and the crc32 of nothing, 0.  Null source: a source of
    its own.  Null ids and repeated rows: rows like any other; rows equal in
    all columns take neighbouring places.  No rows: no rows.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    narrow = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # Written first: the sampling of the range sort then reads narrow rows only, not the texts again.
    narrow = common.staged(narrow.withColumn("_row", F.monotonically_increasing_id())
                                 .withColumn("_mix", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")), "shard-rows")
    keys = ["source", "_mix", "doc_id", "_row"]
    shuffled = common.staged(
        narrow.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys])
              .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys])
              .withColumn("_at", F.monotonically_increasing_id()), "shard-shuffled")
    ranked = (common.numbered(shuffled, ["source"], "_rank", "_of")
              .withColumn("_fraction", (F.col("_rank") + 0.5) / F.col("_of")).drop("_at"))
    placed = common.row_numbers(ranked.drop("_rank", "_of"), ["_fraction", "_mix", "doc_id", "_row"], "shard-placed")
    n, pos, total = F.lit(n_shards).cast("long"), F.col("_pos"), F.col("_total")
    shard = F.expr(f"(_pos * {int(n_shards)}L) div _total")
    return (placed.withColumn("shard", shard.cast("int"))
            .select("doc_id", "source", "size", "text_crc32", "shard",
                    # the first position of shard s is ceil(s * total / n)
                    (pos - F.expr(f"(shard * _total + {int(n_shards) - 1}L) div {int(n_shards)}L")).alias("slot")))


def digest(shards: DataFrame) -> DataFrame:
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "source")
