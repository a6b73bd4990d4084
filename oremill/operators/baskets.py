"""Building baskets.

The working form of a basket is *long*: distinct ``(key, item)`` rows.  It
shuffles on both columns, so a basket or an item that owns a large share of the
input is spread over many tasks.  ``basket_sets`` is the array form for output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.operators.numbering import ranks_within
from oremill.plans.staging import stage, stage_counted, stage_observed

ROW_ITEMS = 1_000  # items in one array of a listing


def basket_rows(df: DataFrame, key: str | Column, item: str | Column) -> DataFrame:
    """Distinct ``(key, item)`` rows; rows with a null key or item are dropped.

    Swap the two arguments to mine the inverted orientation.
    """
    key = F.col(key) if isinstance(key, str) else key
    item = F.col(item) if isinstance(item, str) else item
    # Plain null tests let the planner see equal inputs as equal and share their shuffle.
    present = F.col("key").isNotNull() & F.col("item").isNotNull()
    return df.select(key.alias("key"), item.alias("item")).where(present).distinct()


def basket_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("size"))


def longer_than(rows: DataFrame, size: int) -> DataFrame:
    """Rows of baskets holding strictly more than ``size`` items."""
    sizes, seen = stage_observed(basket_sizes(rows), "sizes", short=F.count_if(F.col("size") <= size))
    if not seen["short"]:  # nothing to leave out, so no row is shuffled or sorted for it
        return rows
    # A join of two stored tables is one whose skewed partitions are split at run time.
    return rows.join(sizes.where(F.col("size") > size).select("key"), "key", "left_semi")


def basket_sets(rows: DataFrame, length: int = ROW_ITEMS) -> DataFrame:
    """``(key, part, items, size)``: each basket as sorted arrays, with its full size.

    ``rows`` are distinct.  An array holds ``length`` items at most: part ``p`` of a basket
    holds those ranked ``p * length + 1`` to ``(p + 1) * length``.  Baskets that fit in one
    array are collected by key; longer ones, which may own any share of the rows, are
    ranked over as many tasks as their rows take.
    """
    rows = stage(rows.select("key", "item"), "baskets")
    long, n_long = stage_counted(basket_sizes(rows).where(F.col("size") > length).select("key"), "long")
    items = F.sort_array(F.collect_list("item")).alias("items")
    whole = rows if not n_long else rows.join(long, "key", "left_anti")
    sets = whole.groupBy("key").agg(items, F.count("*").alias("size")).select("key", F.lit(0).alias("part"), "items", "size")
    if not n_long:
        return sets
    ranked = ranks_within(rows.join(long, "key", "left_semi"), ["key"], "item")
    part = F.expr(f"cast((rank - 1) div {length} as int)").alias("part")
    return sets.unionByName(ranked.groupBy("key", part, "size").agg(items).select("key", "part", "items", "size"))


def item_support(rows: DataFrame, support: int = 1) -> DataFrame:
    """``(item, support)`` for items in at least ``support`` baskets."""
    return rows.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= support)


def scaled_support(part_baskets: str, support: int, baskets: int) -> Column:
    """``ceil(part_baskets * support / baskets)`` in exact integer arithmetic."""
    return F.expr(f"(cast({part_baskets} as decimal(38, 0)) * {support} + {baskets - 1}) div {baskets}")
