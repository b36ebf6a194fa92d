"""Distributed running totals, ranks, tiles and exact medians.

``Window.orderBy(...)`` without a partition plans ``Exchange SinglePartition``:
every row goes through one task.  That is fine for a few hundred month rows,
not for one row per account or caterer.  The helpers here compute the same
numbers with a segmented prefix sum:

1. range-partition the rows on the full, unique sort key (Spark samples the
   bounds, so even a value shared by a third of the rows is split across
   ranges because the tie-breaking columns continue the order);
2. total each measure per range (at most one row per range and group);
3. a window over that small table gives each range the total of the ranges
   before it, which is joined back;
4. a window partitioned by range adds the running sum inside the range.

The range-tagged rows are materialised with a reliable checkpoint (see
``tag_ranges``).  Callers whose input is expensive to recompute (an aggregate
over all orders) materialise it first, since the helpers read it more than
once (the per-value table and the join back).

Ranks over values with ties (``percent_rank`` and RANGE-frame sums) first
collapse the rows to one row per distinct value with a partial aggregation,
so a heavily repeated value costs one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def tag_ranges(df: DataFrame, order_by: Sequence[Column], partition_by: Sequence[str] = (),
               num_ranges: int | None = None) -> DataFrame:
    """Materialised copy of ``df`` with ``_rng``: the index of its contiguous range of the sort order."""
    keys = [*[F.col(c) for c in partition_by], *order_by]
    # Without a count AQE coalesces ranges of few rows.
    ranged = df.repartitionByRange(num_ranges, *keys) if num_ranges else df.repartitionByRange(*keys)
    # Two evaluations of a range exchange may sample different bounds, so the
    # tagged rows are written once and every consumer reads that copy.
    return materialize(ranged.withColumn("_rng", F.spark_partition_id()))


def running_totals(df: DataFrame, order_by: Sequence[Column], measures: dict[str, Column],
                   partition_by: Sequence[str] = (), num_ranges: int | None = None,
                   with_totals: bool = False) -> DataFrame:
    """Add one column per measure: its ROWS-frame running sum in the given order.

    ``order_by`` must be a total order within ``partition_by`` (add a unique
    tie-breaker).  The result equals
    ``sum(m).over(Window.partitionBy(*partition_by).orderBy(*order_by)
    .rowsBetween(unboundedPreceding, currentRow))`` without a single-task
    stage.  With ``with_totals`` each measure's group total is added as
    ``<name>_total``, read off the per-range table at no extra pass.
    """
    names = list(measures)
    staged = df.select("*", *[measures[k].alias(f"_m_{k}") for k in names])
    ranged = tag_ranges(staged, order_by, partition_by, num_ranges)

    # Totals per (group, range): bounded by groups + ranges.
    totals = ranged.groupBy(*partition_by, "_rng").agg(*[F.sum(f"_m_{k}").alias(f"_t_{k}") for k in names])
    before = Window.partitionBy(*partition_by).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*partition_by)
    offsets = totals.select(
        *[F.col(c).alias(f"_g_{c}") for c in partition_by], F.col("_rng").alias("_o_rng"),
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in names],
        *[F.sum(f"_t_{k}").over(whole).alias(f"_T_{k}") for k in names])

    inside = Window.partitionBy(*partition_by, "_rng").orderBy(*order_by) \
                   .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(f"_m_{k}").over(inside).alias(f"_l_{k}") for k in names])

    cond = local["_rng"] == offsets["_o_rng"]
    for c in partition_by:
        cond = cond & local[c].eqNullSafe(offsets[f"_g_{c}"])
    joined = local.join(offsets, cond)
    extra = [F.col(f"_T_{k}").alias(f"{k}_total") for k in names] if with_totals else []
    return joined.select(*[local[c] for c in df.columns],
                         *[(F.col(f"_o_{k}") + F.col(f"_l_{k}")).alias(k) for k in names], *extra)


def percent_rank(df: DataFrame, key: str, out: str, ascending: bool = True,
                 nulls_last: bool = True, num_ranges: int | None = None) -> DataFrame:
    """``percent_rank() OVER (ORDER BY key)`` over the whole frame."""
    k = F.col(key)
    order = (k.asc_nulls_last() if nulls_last else k.asc_nulls_first()) if ascending else \
            (k.desc_nulls_last() if nulls_last else k.desc_nulls_first())
    values = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_totals(values, [order], {"_cum": F.col("_c")}, num_ranges=num_ranges, with_totals=True)
    n = F.col("_cum_total")
    pr = ranked.select(
        F.col(key).alias("_pr_key"),
        F.when(n > 1, (F.col("_cum") - F.col("_c")).cast("double") / (n - 1).cast("double"))
         .otherwise(F.lit(0.0)).alias(out))
    return df.join(pr, df[key].eqNullSafe(pr["_pr_key"])).drop("_pr_key")


def range_running_sum(df: DataFrame, key: str, measure: str, out: str, descending: bool = False,
                      num_ranges: int | None = None, total: str | None = None) -> DataFrame:
    """``sum(measure) OVER (ORDER BY key [DESC])`` with the default RANGE frame (peers included).

    With ``total`` the grand total ``sum(measure) OVER ()`` is added too.
    """
    k = F.col(key)
    order = k.desc_nulls_first() if descending else k.asc_nulls_last()
    values = df.groupBy(key).agg(F.sum(measure).alias("_s"))
    ranked = running_totals(values, [order], {out: F.col("_s")}, num_ranges=num_ranges, with_totals=True)
    cols = [F.col(key).alias("_rs_key"), out] + ([F.col(f"{out}_total").alias(total)] if total else [])
    ranked = ranked.select(*cols)
    return df.join(ranked, df[key].eqNullSafe(ranked["_rs_key"])).drop("_rs_key")


def ntile(df: DataFrame, order_by: Sequence[Column], tiles: int, out: str,
          num_ranges: int | None = None) -> DataFrame:
    """``ntile(tiles) OVER (ORDER BY order_by)``; ``order_by`` must be a total order."""
    numbered = running_totals(df, order_by, {"_rn": F.lit(1).cast("long")}, num_ranges=num_ranges,
                              with_totals=True)
    rn, n = F.col("_rn"), F.col("_rn_total")
    q = (n - n % tiles) / tiles          # rows per tile (n div tiles), exact
    r = n % tiles                        # the first r tiles hold one extra row
    big = r * (q + 1)
    idiv = lambda a, b: ((a - a % b) / b)  # noqa: E731  exact integer quotient
    safe_q = F.when(q == 0, F.lit(1)).otherwise(q)
    tile = F.when(rn <= big, idiv(rn - 1, q + 1) + 1).otherwise(r + idiv(rn - big - 1, safe_q) + 1)
    return numbered.withColumn(out, tile.cast("long")).drop("_rn", "_rn_total")


def middle_values(df: DataFrame, group_cols: Sequence[str], value: str,
                  num_ranges: int | None = None) -> DataFrame:
    """Per group, the two middle values of ``value`` (equal when the count is odd).

    ``(lo + hi) / 2`` is the exact median (``PERCENTILE_CONT(0.5)``); NULLs are
    skipped.  The distributed form works on distinct values with counts,
    spread over ranges, so no group is ever held by one task.
    """
    values = df.filter(F.col(value).isNotNull()).groupBy(*group_cols, value).agg(F.count(F.lit(1)).alias("_c"))
    joined = running_totals(values, [F.col(value).asc()], {"_cum": F.col("_c")},
                            partition_by=list(group_cols), num_ranges=num_ranges, with_totals=True)
    n = F.col("_cum_total")
    lo_pos = F.floor((n - 1) / 2) + 1
    hi_pos = F.ceil((n - 1) / 2) + 1
    first = F.col("_cum") - F.col("_c")
    at = lambda pos: (first < pos) & (pos <= F.col("_cum"))
    return joined.filter(at(lo_pos) | at(hi_pos)).groupBy(*group_cols).agg(
        F.max(F.when(at(lo_pos), F.col(value))).alias("_med_lo"),
        F.max(F.when(at(hi_pos), F.col(value))).alias("_med_hi"))
