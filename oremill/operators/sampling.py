"""Fixed-size reservoir samples and bootstrap batches with reproducible draws.

Every random choice is a hash of (seed, arrival number), so a result does not
depend on partitioning, and a re-run task repeats its draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.functions.hashing import draw32, draw48
from oremill.operators.sketches import batch_of

SNAPSHOT_SLOTS = (0, 20, 40, 60, 80)


def replacements(stream: DataFrame, k: int, seed: int) -> DataFrame:
    """``(n, user, slot)``: the arrivals that enter the sample, and where.

    The first ``k`` fill the slots in order.  Arrival ``n`` > ``k`` is accepted
    with probability ``k / n`` and overwrites a uniform slot.  About
    ``k * (1 + ln(N / k))`` of N rows remain.
    """
    entered = stream.select("n", "user", entry_slot(F.col("n"), k, seed).alias("slot"))
    return entered.where(F.col("slot").isNotNull())


def entry_slot(n: Column, k: int, seed: int) -> Column:
    """The slot that arrival ``n`` enters, null if it does not."""
    if not 0 < k < 2**15:
        raise ValueError("k must be 1..32767")
    # A quotient instead of a product with n: no stream is long enough to overflow it.
    accepted = draw48(seed, n) < F.call_function("div", F.lit(k * 2**48), n)
    slot = F.when(n <= k, n - 1).when(accepted, draw32(seed, n, 2) % F.lit(k))
    return slot.cast("int")


def reservoir(stream: DataFrame, k: int, seed: int) -> DataFrame:
    """``(slot, user, n)``: the sample after the whole stream."""
    return (
        replacements(stream, k, seed)
        .groupBy("slot")
        .agg(F.max_by("user", "n").alias("user"), F.max("n").alias("n"))
    )


def snapshots(
    entered: DataFrame, batches: DataFrame, slots: tuple[int, ...] = SNAPSHOT_SLOTS
) -> DataFrame:
    """``(batch, seqnum, <slot>_id…)``: chosen slots of the sample after each batch.

    ``entered`` comes from ``replacements``; ``batches`` is ``(batch, seqnum)``
    with the last arrival of each batch.  A slot changes hands about ln(N) times,
    so its history is one short array, joined to the batches by slot.
    """
    history = (
        entered.where(F.col("slot").isin(list(slots)))
        .groupBy("slot")
        .agg(F.array_sort(F.collect_list(F.struct("n", "user"))).alias("history"))
    )
    asked = batches.select("batch", "seqnum", F.explode(F.array(*map(F.lit, slots))).alias("slot"))
    # One row per slot, each holding about ln(N) entries: small enough to broadcast at any N.
    holder = asked.join(F.broadcast(history), "slot").select(
        "batch",
        "seqnum",
        "slot",
        F.element_at(
            F.filter("history", lambda entry: entry["n"] <= F.col("seqnum")), -1
        )["user"].alias("user"),
    )
    return holder.groupBy("batch", "seqnum").agg(
        *[F.max(F.when(F.col("slot") == s, F.col("user"))).alias(f"{s}_id") for s in slots]
    )


def reservoir_snapshots(
    stream: DataFrame, k: int, size: int, seed: int, slots: tuple[int, ...] = SNAPSHOT_SLOTS
) -> DataFrame:
    """Sample snapshots after every batch of ``size`` arrivals."""
    if max(slots) >= k:
        raise ValueError("slots must be below the sample size")
    batches = stream.groupBy(batch_of(F.col("n"), size).alias("batch")).agg(F.max("n").alias("seqnum"))
    return snapshots(replacements(stream, k, seed), batches, slots)


def drawn_row(draw: Column, seed: int, rows: int) -> Column:
    """The row, from 0, that a draw picks among ``rows``."""
    return F.pmod(draw32(seed, draw, 0) * F.lit(65536) + F.floor(draw32(seed, draw, 1) / 65536), F.lit(rows))


def bootstrap_batches(df: DataFrame, index: str | Column, batch_size: int, n_batches: int, seed: int) -> DataFrame:
    """``n_batches`` batches of ``batch_size`` rows drawn uniformly with replacement.

    ``index`` is a dense zero-based row number.  Returns ``(draw, batch)`` plus
    the columns of ``df``.
    """
    index = F.col(index) if isinstance(index, str) else index
    total = df.count()
    draws = df.sparkSession.range(batch_size * n_batches).select(
        F.col("id").alias("draw"),
        F.floor(F.col("id") / F.lit(batch_size)).cast("bigint").alias("batch"),
        drawn_row(F.col("id"), seed, total).alias("_row"),
    )
    return draws.join(df.withColumn("_row", index.cast("bigint")), "_row").drop("_row")
