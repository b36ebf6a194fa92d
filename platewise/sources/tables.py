"""Loading the canonical marketplace tables.

Two layouts are understood:

* canonical parquet: one folder per table (``orders/``, ``corporate_accounts/``
  ...), read with the declared schema.  This is the production layout; facts
  should be written sorted by ``placed_at`` (or partitioned by month) so that
  date-range filters prune row groups.
* the driver's TPC-H-style test tables (``customer.parquet`` ...), mapped by
  :mod:`platewise.sources.adapter`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import adapter, schemas


@dataclass(frozen=True)
class Marketplace:
    corporate_accounts: DataFrame
    caterers: DataFrame
    orders: DataFrame
    order_items: DataFrame
    delivery_events: DataFrame
    promotions: DataFrame
    promo_orders: DataFrame
    experiment_assignments: DataFrame

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in schemas.SCHEMAS}


def load(spark: SparkSession, path: str, layout: str = "canonical") -> Marketplace:
    """Tables from ``path``: ``layout`` is ``"canonical"`` (a folder per table) or ``"test"`` (the driver's tables)."""
    if layout == "test":
        return Marketplace(**adapter.load_tables(spark, path))
    if layout != "canonical":
        raise ValueError(f"unknown layout {layout!r}")
    return Marketplace(**{
        name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in schemas.SCHEMAS.items()
    })


def write_canonical(market: Marketplace, path: str, mode: str = "errorifexists") -> None:
    """Write the canonical layout once (an ingest step), facts clustered by time."""
    for name, df in market.as_dict().items():
        writer = df
        if name == "orders":
            # Range-partition on the time column so every file covers a narrow
            # placed_at span: date filters then skip files and row groups.  The
            # order_id tie-breaker splits a timestamp shared by many orders (a
            # whole day, or a hot day) across files instead of one task.
            writer = df.repartitionByRange("placed_at", "order_id").sortWithinPartitions("placed_at", "order_id")
        writer.write.mode(mode).parquet(f"{path}/{name}")
