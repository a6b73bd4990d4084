"""Row numbers, running sums and ranks over whole tables, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oremill.plans.staging import stage

_PLACE_BITS = 33  # monotonically_increasing_id keeps a row's place in its partition in these


def _placed(df: DataFrame, order: tuple[str | Column, ...]) -> DataFrame:
    """``df`` stored in range partitions, with the number of a row's partition and its place there."""
    at = F.monotonically_increasing_id()
    placed = df.orderBy(*order).withColumns(
        {"_part": F.shiftright(at, _PLACE_BITS), "_at": at.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))}
    )
    return stage(placed, "ordered")


def row_numbers(df: DataFrame, *order: str | Column, name: str = "n") -> DataFrame:
    """``df`` with ``name``: the row's number, from 1, in the given order.

    The rows are sorted into range partitions and stored with their places there; a
    row's number is its place plus the counts of the partitions before.  Only one count
    a partition meets in a window.  Name columns that tell rows apart: rows that the
    order holds equal are numbered as they come.
    """
    placed = _placed(df, order)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    numbered = placed.join(stage(before, "before"), "_part")
    return numbered.select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias(name))


def running_sums(df: DataFrame, columns: list[str], *order: str | Column) -> DataFrame:
    """``df`` with each of ``columns`` summed over all rows up to this one, in the given order.

    Sums run within the range partitions; only one row of sums a partition meets in a
    window over all.  Null counts as 0.
    """
    placed = _placed(df, order)
    sums = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in columns])
    upto = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = {c: F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.col(f"_{c}") for c in columns}
    met = placed.join(stage(before, "before"), "_part")
    return met.select(*[summed[c].alias(c) if c in summed else c for c in df.columns])


def ranks_within(df: DataFrame, groups: list[str], *order: str | Column, name: str = "rank") -> DataFrame:
    """``df`` with ``name`` and ``size``: the row's rank, from 1, in its group and the group's rows.

    A group may hold any share of the rows: it spans as many range partitions as it
    needs.  Its first number and its count, combined before the shuffle, turn row
    numbers into ranks.
    """
    numbered = stage(row_numbers(df, *groups, *order, name="_n"), "numbered")
    starts = numbered.groupBy(*groups).agg(F.min("_n").alias("_start"), F.count("*").alias("size"))
    met = numbered.join(stage(starts, "starts"), groups)
    return met.select(*df.columns, (F.col("_n") - F.col("_start") + 1).alias(name), "size")
