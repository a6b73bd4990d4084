"""Bloom-filter tracking and trailing-zero distinct counting over numbered streams.

A stream is a DataFrame ``(n, user)`` where ``n`` = 1, 2, 3, … is the arrival
number.  Batch ``b`` holds the elements ``b * size + 1 … (b + 1) * size``.  Both
summaries are order-free aggregates of ``n``, so nothing is replayed in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.functions.hashing import HashFamily, hash_values, trailing_zeros, utf8_int_mod
from oremill.plans.staging import stage


def numbered(df: DataFrame, sequence: str | Column, user: str | Column) -> DataFrame:
    """``(n, user)`` from a dense zero-based ``sequence`` column."""
    sequence = F.col(sequence) if isinstance(sequence, str) else sequence
    user = F.col(user) if isinstance(user, str) else user
    stream = df.select((sequence + 1).cast("bigint").alias("n"), user.cast("string").alias("user"))
    return stream.where(F.col("n").isNotNull() & F.col("user").isNotNull())


def batch_of(n: Column, size: int) -> Column:
    """Zero-based batch number of arrival ``n``."""
    return F.call_function("div", n - 1, F.lit(size))


def first_arrivals(stream: DataFrame) -> DataFrame:
    """``(user, first)``: only a user's first arrival can be a false positive."""
    return stream.groupBy("user").agg(F.min("n").alias("first"))


def bloom_outcomes(first: DataFrame, family: HashFamily) -> DataFrame:
    """``(first, positive)`` for each first arrival, against the filter state just before it.

    Bit ``h`` is set before arrival ``n`` exactly when the earliest arrival that
    hashes to ``h`` is below ``n``, so the whole history of the filter is one
    minimum per bit (at most ``family.buckets`` rows).  Residues are staged: users
    are hashed once each, after they have been made distinct.
    """
    residues = stage(with_residue(first, family).select("first", "x"), "residues")
    probes = residues.select("first", F.explode(F.array(*hash_values(F.col("x"), family))).alias("bit"))
    bits = probes.groupBy("bit").agg(F.min("first").alias("set_at"))
    return (
        probes.join(bits, "bit")
        .groupBy("first")
        .agg(F.bool_and(F.col("set_at") < F.col("first")).alias("positive"))
    )


def false_positive_rates(outcomes: DataFrame, batches: DataFrame, size: int) -> DataFrame:
    """``(batch, fp, tn, fpr)`` for every batch in ``batches``; the rate is 0 without new users."""
    per_batch = outcomes.groupBy(batch_of(F.col("first"), size).alias("batch")).agg(
        F.count_if("positive").alias("fp"), F.count_if(~F.col("positive")).alias("tn")
    )
    fp, tn = F.coalesce("fp", F.lit(0)), F.coalesce("tn", F.lit(0))
    return batches.join(per_batch, "batch", "left").select(
        "batch",
        fp.alias("fp"),
        tn.alias("tn"),
        F.coalesce(F.try_divide(fp, fp + tn), F.lit(0.0)).alias("fpr"),
    )


def bloom_fpr(stream: DataFrame, size: int, family: HashFamily) -> DataFrame:
    """False-positive rate per batch of a Bloom filter whose state spans all batches."""
    batches = stream.select(batch_of(F.col("n"), size).alias("batch")).distinct()
    return false_positive_rates(bloom_outcomes(first_arrivals(stream), family), batches, size)


def with_residue(df: DataFrame, family: HashFamily) -> DataFrame:
    """Add ``x``, so that a user's text is folded once and not once per hash function."""
    return df.withColumn("x", utf8_int_mod(F.col("user"), family.prime))


def register_columns(family: HashFamily) -> list[Column]:
    """One ``max(trailing zeros)`` aggregate per hash function of ``x``."""
    values = hash_values(F.col("x"), family)
    return [F.max(trailing_zeros(value)).alias(f"r{i}") for i, value in enumerate(values)]


def fm_estimate_column(registers: list[Column], groups: int = 1) -> Column:
    """Median over groups of the mean of ``2^register``, rounded half to even."""
    if groups < 1 or len(registers) % groups:
        raise ValueError("groups must divide the number of hash functions")
    width = len(registers) // groups
    powers = F.array_sort(F.array(*[F.pow(F.lit(2.0), r) for r in registers]))
    means = [
        F.aggregate(F.slice(powers, 1 + g * width, width), F.lit(0.0), lambda acc, x: acc + x) / F.lit(width)
        for g in range(groups)
    ]
    ordered = F.array_sort(F.array(*means))
    low, high = (groups - 1) // 2, groups // 2
    return F.bround((ordered[low] + ordered[high]) / F.lit(2.0), 0).cast("bigint")


def fm_estimate(stream: DataFrame, size: int, family: HashFamily, groups: int = 1) -> DataFrame:
    """``(batch, truth, estimate)``: exact and estimated distinct users of each batch.

    Users are made distinct per batch first, so a user repeated many times is
    hashed once and never concentrates on one task.
    """
    users = stream.select(batch_of(F.col("n"), size).alias("batch"), "user").distinct()
    state = (
        with_residue(users, family)
        .groupBy("batch")
        .agg(F.count("*").alias("truth"), *register_columns(family))
    )
    names = [F.col(f"r{i}") for i in range(len(family))]
    return state.select("batch", "truth", fm_estimate_column(names, groups).alias("estimate"))
