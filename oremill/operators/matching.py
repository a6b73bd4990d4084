"""First-fit matching of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oremill.plans.staging import stage, stage_counted, unstage

HEADS = 256  # heads that are matched at once


def first_fit(pairs: DataFrame, heads: int = HEADS) -> DataFrame:
    """The pairs that a walk in order of ``(a, b)`` takes when it takes each pair with both ends free.

    ``pairs`` has columns ``a < b``; the same rows come back, each end in one pair at most.
    In other words: in their order, each free head ``a`` takes its first free partner.
    The walk goes over ``heads`` heads at a time: these use up no more than ``2 * heads``
    ends, so as many partners of each and one more decide, whatever the table holds.
    Pairs whose ends are used up leave the table before the next heads are taken up.
    Null ends fit nothing; repeated pairs count once.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    left = pairs.select("a", "b").where(F.col("a") < F.col("b")).distinct()
    left, n_left = stage_counted(left, "pairs")
    if not n_left:
        return left
    taken = None
    while n_left:
        first = left.select("a").distinct().orderBy("a").limit(heads + 1)
        seen = first.agg(F.count("*"), F.max("a")).first()
        last = seen[0] <= heads
        upto = seen[1] if last else first.orderBy("a").limit(heads).agg(F.max("a")).first()[0]
        nearest = Window.partitionBy("a").orderBy("b")
        block = left.where(F.col("a") <= upto).withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= 2 * heads + 1)
        lists = block.groupBy("a").agg(F.collect_list("b").alias("bs"))
        walked = lists.agg(F.array_sort(F.collect_list(F.struct("a", "bs"))).alias("heads")).select(F.expr(_walk(kind)).alias("pairs"))
        found = stage(walked.select(F.inline("pairs")), "matched")
        taken = found if taken is None else taken.unionByName(found)
        if last:
            break
        gone = found.select(F.explode(F.array("a", "b")).alias("end"))
        rest = left.where(F.col("a") > upto)
        rest = rest.join(gone, rest["a"] == gone["end"], "left_anti").join(gone, rest["b"] == gone["end"], "left_anti")
        rest, n_left = stage_counted(rest, "pairs")
        unstage(left)
        left = rest
    unstage(left)
    return taken


def _walk(kind: str) -> str:
    """The pairs taken from ``heads``, an array of heads in order with their partners."""
    partner = "array_min(array_except(head.bs, so_far.used))"
    return f"""aggregate(
      heads,
      named_struct('used', cast(array() as array<{kind}>), 'pairs', cast(array() as array<struct<a: {kind}, b: {kind}>>)),
      (so_far, head) -> if(
        array_contains(so_far.used, head.a) or {partner} is null,
        so_far,
        named_struct(
          'used', concat(so_far.used, array(head.a, {partner})),
          'pairs', concat(so_far.pairs, array(named_struct('a', head.a, 'b', {partner})))
        )
      ),
      so_far -> so_far.pairs
    )"""
