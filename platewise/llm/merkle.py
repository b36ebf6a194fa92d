"""Merkle manifest of a dataset: leaves per row, a tree per group, one root, and the proof of every leaf.

A node is the lowercase hex sha256 of its children's hashes, concatenated as
text; up to ``FANOUT`` consecutive nodes have one parent.  Each level is
built from the one below and stored as *runs*: the children of one node, with
a link to the run that holds that node (``up``) and its place there.  The
groups' subroots are the leaves of a last tree whose node is the root.

A proof is climbed by a recursive query over the stored runs.  A row of it is a
bottom run, whose leaves have the same siblings at all higher levels: the query
appends those once for the run, and folds the hash of each leaf of its own.

Everything is DataFrame and SQL functions; the text is read once, in the scan
that makes the leaves, and no text is shuffled.
"""

from __future__ import annotations

import functools
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FANOUT = 8
#: Hex digits of a hash.
HEX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LINK = "struct<tree:bigint,level:int,run:bigint>"
#: The tree over the subroots; the groups' own trees are numbered from 0.
TOP = -1


def sha(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def leaf_text(fields: dict[str, Column]) -> Column:
    """The fields one after another: ``-`` for null, else the byte count, ``:`` and the value."""
    shown = [value.cast("string") for value in fields.values()]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown])


def is_tampered(doc_id: Column) -> Column:
    """Rows whose decimal id has a crc32 that 3 divides; never those without id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, leaf, tampered``: the hash of each row, and of the row as tampered with (else the same)."""
    fields = {c: docs[c].cast("long" if c in ("doc_id", "n_chars") else "string") for c in FIELDS}
    changed = fields | {"text": F.translate(fields["text"], UPPER, LOWER)}
    return (docs.select(fields["doc_id"].alias("doc_id"), fields["lang"].alias("lang"), sha(leaf_text(fields)).alias("leaf"),
                        F.when(is_tampered(fields["doc_id"]), sha(leaf_text(changed))).alias("_changed"))
                .select("doc_id", "lang", "leaf", F.coalesce("_changed", "leaf").alias("tampered")))


def numbered_leaves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves with ``tree, pos, size`` (the number of their group, their place in it, its leaves), and the groups.

    Groups are in the order of their names, null first; in a group leaves are
    by id, null first, and repeated ids by hash.
    """
    order = ["lang", "doc_id", "leaf", "tampered"]
    sort = [F.col(c).asc_nulls_first() for c in order]
    ordered = common.staged(rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
                            .withColumn("_at", F.monotonically_increasing_id()), "merkle-leaves")
    placed = common.numbered(ordered, ["lang"], "pos", "size")
    groups = ordered.groupBy("lang").agg(F.count(F.lit(1)).alias("_size"))
    groups = common.row_numbers(groups, ["lang"], "merkle-groups").select(
        F.col("lang").alias("_lang"), F.col("_pos").alias("tree"), F.col("_total").alias("trees"), "_size")
    groups = common.staged(groups, "merkle-trees")
    return placed.join(groups, placed["lang"].eqNullSafe(groups["_lang"])).drop("_lang", "_size", "_at"), groups


def run_of(pos: Column) -> Column:
    return F.floor(pos / FANOUT).cast("long")


def parents(size: Column) -> Column:
    return F.ceil(size / FANOUT).cast("long")


def _linked(runs: DataFrame, last: Column, up_top: Column) -> DataFrame:
    """The runs with the link to the run above; a tree's last run links into the tree over the subroots."""
    top = F.when(up_top, F.struct(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), run_of(F.col("tree")).alias("run")))
    own = F.struct(F.col("tree"), (F.col("level") + 1).cast("int").alias("level"), run_of(F.col("run")).alias("run"))
    return (runs.withColumn("up", F.when(last, top).otherwise(own).cast(LINK))
                .withColumn("place", F.when(last, F.col("tree")).otherwise(F.col("run")) % FANOUT))


def _levels(nodes: DataFrame, first: int, sizes: list[int], trees: int) -> tuple[list[DataFrame], DataFrame]:
    """Stored runs of every level over ``nodes (tree, pos, hash, size)`` of level ``first``, and ``(tree, root)`` of each tree.

    ``sizes`` has the largest number of nodes of a tree at each level that has
    more than one; a tree is finished where one node remains.  The last runs of
    ``trees`` trees link into the tree over them, if they are several.
    """
    levels, roots = [], [nodes.filter("size = 1")]
    for level in range(len(sizes)):
        members = F.sort_array(F.collect_list(F.struct("pos", "hash")))
        runs = (nodes.filter("size > 1").groupBy("tree", run_of(F.col("pos")).alias("run"), "size")
                     .agg(F.concat_ws("", F.transform(members, lambda m: m["hash"])).alias("children"))
                     .withColumn("level", F.lit(first + level)).withColumn("node", sha(F.col("children")))
                     .withColumn("size", parents(F.col("size"))))
        runs = common.staged(_linked(runs, F.col("size") == 1, F.lit(trees > 1)), "merkle-runs")
        levels.append(runs)
        nodes = runs.select("tree", F.col("run").alias("pos"), F.col("node").alias("hash"), "size")
        roots.append(nodes.filter("size = 1"))
    return levels, functools.reduce(DataFrame.unionByName, roots).select("tree", F.col("hash").alias("root"))


def level_sizes(largest: int) -> list[int]:
    """Nodes of the largest tree at each level that has more than one."""
    out = []
    while largest > 1:
        out.append(largest)
        largest = -(-largest // FANOUT)
    return out


@contextmanager
def _recursion_of_any_size(spark: SparkSession):
    """Spark stops recursive queries at a million rows by default; here the rows are those of the input."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: From each bottom run upwards: the siblings met, and the hash of each leaf folded with them.
CLIMB = f"""
WITH RECURSIVE climb (tree, run, up, place, folded, above) AS (
  SELECT tree, run, up, place, folded, '' FROM {{bottom}}
  UNION ALL
  SELECT c.tree, c.run, r.up, r.place,
         transform(c.folded, h -> sha2(CAST(concat(left(r.children, {HEX} * c.place), h, substr(r.children, {HEX} * (c.place + 1) + 1)) AS BINARY), 256)),
         concat(c.above, left(r.children, {HEX} * c.place), substr(r.children, {HEX} * (c.place + 1) + 1))
  FROM climb c JOIN {{runs}} r ON r.tree = c.up.tree AND r.level = c.up.level AND r.run = c.up.run
)
SELECT tree, run, folded, above FROM climb WHERE up IS NULL"""


def manifest(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``leaf``, ``subroot``, ``root`` and the proof are of the rows as they are;
    ``folded_root`` is recomputed from the tampered leaf (see
    :func:`is_tampered`) and the proof.  Null fields count as ``-``, null ids
    come first and are never tampered with, repeated rows are leaves of their
    own.  A single leaf is its own subroot and root, with the proof of no
    siblings.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    placed, groups = numbered_leaves(leaves(docs))
    largest, trees = groups.agg(F.max("_size"), F.max("trees")).first()
    largest, trees = largest or 0, trees or 0

    # the bottom runs: leaves of one run climb together
    members = F.sort_array(F.collect_list(F.struct("pos", "doc_id", "lang", "leaf", "tampered")))
    rows = (placed.groupBy("tree", run_of(F.col("pos")).alias("run"), "size").agg(members.alias("members"))
                  .withColumn("level", F.lit(0)).withColumn("children", F.concat_ws("", F.col("members.leaf"))))
    folded = F.expr(f"""transform(members, (m, i) -> IF(size = 1, m.tampered, sha2(CAST(concat(
        left(children, {HEX} * i), m.tampered, substr(children, {HEX} * (i + 1) + 1)) AS BINARY), 256)))""")
    node = F.when(F.col("size") == 1, F.col("children")).otherwise(sha(F.col("children")))
    bottom = common.staged(_linked(rows.withColumns({"folded": folded, "node": node}), F.col("size") <= FANOUT, F.lit(trees > 1)),
                           "merkle-bottom")
    levels, subroots = _levels(bottom.select("tree", F.col("run").alias("pos"), F.col("node").alias("hash"),
                                             parents(F.col("size")).alias("size")), 1, level_sizes(largest)[1:], trees)
    subroots = common.staged(subroots, "merkle-subroots")
    tops, root = _levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("root").alias("hash"),
                                         F.lit(trees).cast("long").alias("size")), 0, level_sizes(trees), 1)
    none = spark.createDataFrame([], f"tree long, level int, run long, children string, up {LINK}, place long")
    stored = functools.reduce(DataFrame.unionByName, [
        part.select("tree", "level", "run", "children", "up", "place") for part in [*levels, *tops]] or [none])
    with _recursion_of_any_size(spark):
        climbed = common.staged(spark.sql(CLIMB, bottom=bottom.select("tree", "run", "up", "place", "folded"), runs=stored), "merkle-climbed")

    root_of = root.select(F.col("root").alias("_root"))
    met = (bottom.join(climbed.withColumnRenamed("folded", "folded_roots"), ["tree", "run"])
                 .join(subroots.withColumnRenamed("root", "subroot"), "tree")
                 .join(F.broadcast(root_of)))  # the one root
    each = met.select("*", F.posexplode("members").alias("_i", "_m"))
    proof = F.concat(F.expr(f"left(children, {HEX} * _i)"), F.expr(f"substr(children, {HEX} * (_i + 1) + 1)"), F.col("above"))
    return each.select(F.col("_m.doc_id").alias("doc_id"), F.col("_m.lang").alias("lang"), F.col("_m.leaf").alias("leaf"), "subroot",
                       F.col("_root").alias("root"), sha(proof).alias("proof_sha256"),
                       F.get("folded_roots", "_i").alias("folded_root"),
                       (F.get("folded_roots", "_i") == F.col("_root")).alias("verified"))
