"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source has a target in words: its share by weight of all words, but at most
``CAP`` times its own words; what the cap cuts off is shared again by weight.  The mix
is dealt in blocks of ``BLOCK`` words.  Sources receive blocks by highest quotients
``target / (2 k + 1)``, so quotas are integers, and a source's quota is dealt to its
shards in the same way by their sizes.

A shard's documents stand in an order given by a seeded hash, end to end.  A quota of
``e`` times its blocks and ``r`` more takes every document ``e`` times and a run of
``r`` full blocks that starts at a seeded place, so nearly all documents are taken
whole or not at all and only the two at a run's ends are cut.

Shards are hash buckets; their number follows the corpus (``SHARD_WORDS``, at most
``MOST_SHARDS``), so a source that holds most words is ordered in many tasks.  The
driver sees one total per source and bucket.

Rows without words (null or empty texts) have size 0 and are taken 0 times.  A null
source is a source, the last one.  Among rows with equal keys and sizes it does not
matter which stands first.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oremill.llm.text import WORD, whole, words

BLOCK = 16
CAP = 3
SHARD_WORDS = 1 << 20
MOST_SHARDS = 256
SEED = 20


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("bigint")


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float = CAP) -> list[float]:
    """Shares of all words by weight, none above ``cap`` times its size."""
    total, left = float(sum(sizes)), float(sum(weights))
    found = [0.0] * len(sizes)
    # Sources meet their cap in the order of cap to weight.
    for i in sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i)):
        share = total * weights[i] / left if left > 0 else 0.0
        found[i] = min(float(cap * sizes[i]), share)
        total -= found[i]
        left -= weights[i]
    return found


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by highest quotients ``votes / (2 k + 1)``, at most ``most`` each; the earlier of equals first."""
    seats = min(seats, sum(most))
    total = float(sum(votes))
    if not seats or total <= 0:
        return [0] * len(votes)
    # A divisor too large deals too few seats, and each of them is part of the result.
    sure = max(seats - len(votes), 0)
    dealt = [min(m, math.floor(v * sure / total + 0.5)) for v, m in zip(votes, most)]
    queue = [(-v / (2 * k + 1), i) for i, (v, k, m) in enumerate(zip(votes, dealt, most)) if k < m and v > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(dealt)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        dealt[i] += 1
        if dealt[i] < most[i]:
            heapq.heappush(queue, (-votes[i] / (2 * dealt[i] + 1), i))
    return dealt


def _plan(totals: dict[str | None, list[int]], weights: Sequence[float], cap: int, block: int) -> tuple[int, list[tuple]]:
    """Number of buckets a shard and, by source and shard: sizes, targets, epochs and run."""
    names = sorted((n for n in totals if n is not None)) + [None] * (None in totals)
    sizes = [sum(totals[n]) for n in names]
    everything = sum(sizes)
    shards = min(MOST_SHARDS, 1 << max(0, math.ceil(math.log2(max(everything / SHARD_WORDS, 1)))))
    merged = MOST_SHARDS // shards
    blocks = [[-(-sum(totals[n][k : k + merged]) // block) for k in range(0, MOST_SHARDS, merged)] for n in names]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], cap)
    quotas = sainte_lague(aims, round(everything / block), [cap * sum(b) for b in blocks])
    rows = []
    for name, size, aim, quota, held in zip(names, sizes, aims, quotas, blocks):
        dealt = sainte_lague(held, quota, [cap * b for b in held])
        for shard, (have, take) in enumerate(zip(held, dealt)):
            epochs, run = divmod(take, have) if have else (0, 0)
            words_held = sum(totals[name][shard * merged : (shard + 1) * merged])
            free = words_held // block - run  # only full blocks begin a run
            rows.append((name, shard, size, aim, epochs, max(free, 0), run * block))
    return merged, rows


def mixed(
    sized: DataFrame,
    weights: Sequence[float],
    key: str = "doc_id",
    source: str = "source",
    size: str = "size",
    cap: int = CAP,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """``sized`` with ``source_size``, ``target``, ``epochs``, ``run_first``, ``run_words`` and ``taken``.

    A row is taken ``epochs`` times whole and once from word ``run_first`` (from 0) for
    ``run_words`` words.  ``weights`` go to the sources by code point order, null last,
    and repeat.  Columns of these names are replaced.
    """
    added = ("source_size", "target", "epochs", "run_first", "run_words", "taken")
    rows = sized.drop(*(c for c in added if c in sized.columns))
    kept = [F.col(f"d.`{c}`").alias(c) for c in rows.columns]
    place = F.xxhash64(F.lit(seed), F.col(key))
    bucket = F.pmod(place, F.lit(MOST_SHARDS)).cast("int")
    sums = rows.groupBy(F.col(source).alias("s"), bucket.alias("b")).agg(F.sum(size).alias("n"))
    totals: dict[str | None, list[int]] = {}
    for row in sums.collect():
        totals.setdefault(row["s"], [0] * MOST_SHARDS)[row["b"]] = row["n"] or 0
    merged, plan = _plan(totals, weights, cap, block)
    deal = rows.sparkSession.createDataFrame(
        plan, "mix_source string, mix_shard int, source_size bigint, target double, epochs int, free bigint, run bigint"
    )
    line = Window.partitionBy("mix_source", "mix_shard").orderBy("mix_place", "mix_key", "mix_size")
    lined = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("d"),
        F.col(source).alias("mix_source"),
        F.floor(bucket / merged).cast("int").alias("mix_shard"),
        place.alias("mix_place"),
        F.col(key).alias("mix_key"),
        F.col(size).alias("mix_size"),
    ).withColumn("mix_first", F.sum("mix_size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("mix_size"))
    joined = lined.alias("l").join(
        deal.alias("p"), F.expr("l.mix_source <=> p.mix_source AND l.mix_shard = p.mix_shard")
    )
    run_at = block * F.pmod(F.xxhash64(F.lit(seed), F.col("p.mix_source"), F.col("p.mix_shard")), F.col("free") + 1)
    first = F.greatest(run_at, F.col("mix_first"))
    last = F.least(run_at + F.col("run"), F.col("mix_first") + F.col("mix_size"))
    part = F.when((F.col("run") > 0) & (last > first), last - first).otherwise(F.lit(0)).cast("bigint")
    return joined.select(
        *kept,
        "source_size",
        "target",
        "epochs",
        F.when(part > 0, first - F.col("mix_first")).otherwise(F.lit(0)).cast("bigint").alias("run_first"),
        part.alias("run_words"),
        (F.col("epochs") * F.col("mix_size") + part).alias("taken"),
    )


def taken_documents(mix: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: a row for every time a document is taken, cut texts joined by spaces.

    The columns are those of ``mix``.
    """
    whole_text = F.transform(F.sequence(F.lit(1), F.col("epochs")), lambda _: F.col(text))
    whole_text = F.when(F.col("epochs") > 0, whole_text).otherwise(F.array().cast("array<string>"))
    cut = F.array_join(F.slice(words(F.col(text)), (F.col("run_first") + 1).cast("int"), F.col("run_words").cast("int")), " ")
    cut = F.when(F.col("run_words") == F.col("size"), F.col(text)).otherwise(cut)
    part = F.when(F.col("run_words") > 0, F.array(cut)).otherwise(F.array().cast("array<string>"))
    return mix.withColumn(text, F.explode(F.concat(whole_text, part)))
