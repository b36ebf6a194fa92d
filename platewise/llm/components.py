"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a minimum per node (combined on the map side) and a join back,
so a node with very many links is never gathered in one place.  Links stay in
stored tables; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node ``u`` passes its smallest neighbour on: to the larger ones, or to the smaller ones and itself."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "n")
    joined = both.join(least, both["u"] == least["n"])
    out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else \
        joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``links (u long, v long)``: the smallest node that each one reaches.

    Self links and repeated links don't matter; links with a null end are ignored; no links, no rows.
    """
    edges = common.staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                          .filter("u <> v").distinct(), "links")
    state = None
    while True:
        edges = common.staged(_star(_star(edges, True), False), "links")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == state:
            # stars with the smallest node in the middle
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
