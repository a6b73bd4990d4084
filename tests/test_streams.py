import random
from collections import Counter
from statistics import mean

import pytest
from pyspark.sql import functions as F

from oremill.functions.hashing import (
    HashFamily,
    OFFSETS,
    SLOPES,
    compact_family,
    draw32,
    draw48,
    trailing_zeros,
    utf8_int_mod,
    wide_family,
)
from oremill.operators.sampling import bootstrap_batches, replacements, reservoir, reservoir_snapshots
from oremill.operators.sketches import bloom_fpr, bloom_outcomes, false_positive_rates, fm_estimate, numbered
from oremill.streaming.summaries import read_stream, stream_first_arrivals, stream_fm, stream_reservoir


def make_users(seed=1, n=730, distinct=300):
    rng = random.Random(seed)
    return [f"user-{rng.randrange(distinct)}-é" if rng.random() < 0.6 else "hot" for _ in range(n)]


def as_stream(spark, users):
    df = spark.createDataFrame(list(enumerate(users)), "seq bigint, who string")
    return numbered(df, "seq", "who")


def hashes(user, family):
    x = int.from_bytes(user.encode(), "big")
    return [((a * x + b) % family.prime) % family.buckets for a, b in zip(family.slopes, family.offsets)]


def zeros(value):
    digits = bin(value)
    return len(digits) - len(digits.rstrip("0"))


def test_string_residue_and_trailing_zeros(spark):
    words = ["a", "abcd", "abcde", "", "日本語テキスト", "x" * 50]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for modulus in (11299, 2147483647):
        got = {r.w: r.m for r in df.select("w", utf8_int_mod(F.col("w"), modulus).alias("m")).collect()}
        assert got == {w: int.from_bytes(w.encode(), "big") % modulus for w in words}
    values = [0, 1, 2, 12, 96, 2**40, 2**40 + 2]
    got = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", trailing_zeros(F.col("v")).alias("z"))
    assert {r.v: r.z for r in got.collect()} == {v: zeros(v) for v in values}
    assert zeros(0) == 1 and zeros(12) == 2


def test_family_constants():
    # The ten slopes.
    assert SLOPES == (45461, 30837, 44899, 34438, 44836, 30873, 43431, 42622, 47150, 48585)
    assert len(OFFSETS) == 10
    with pytest.raises(ValueError):
        HashFamily((1,), (1,), 2**40, 10)


@pytest.mark.parametrize("family", [compact_family(), wide_family(4096)])
def test_bloom_replays_the_sequential_filter(spark, family):
    users, size = make_users(), 100
    bits, visited, expected = set(), set(), []
    for start in range(0, len(users), size):
        fp = tn = 0
        for user in users[start : start + size]:
            mine = hashes(user, family)
            if all(h in bits for h in mine):
                fp += user not in visited
            else:
                tn += 1
            bits.update(mine)
            visited.add(user)
        expected.append((start // size, fp, tn, fp / (fp + tn) if fp + tn else 0.0))
    got = bloom_fpr(as_stream(spark, users), size, family).orderBy("batch").collect()
    assert [tuple(r) for r in got] == expected


def test_bloom_batch_without_new_users(spark):
    got = bloom_fpr(as_stream(spark, ["a"] * 7), 3, compact_family()).orderBy("batch").collect()
    assert [tuple(r) for r in got] == [(0, 0, 1, 0.0), (1, 0, 0, 0.0), (2, 0, 0, 0.0)]


@pytest.mark.parametrize("groups", [1, 2, 5])
def test_fm_replays_the_registers(spark, groups):
    users, size, family = make_users(2), 150, compact_family()
    expected = []
    for start in range(0, len(users), size):
        batch = users[start : start + size]
        registers = [max(zeros(hashes(u, family)[i]) for u in batch) for i in range(10)]
        powers = sorted(2**r for r in registers)
        width = 10 // groups
        means = sorted(mean(powers[i : i + width]) for i in range(0, 10, width))
        middle = (means[(groups - 1) // 2] + means[groups // 2]) / 2
        expected.append((start // size, len(set(batch)), round(middle)))
    got = fm_estimate(as_stream(spark, users), size, family, groups).orderBy("batch").collect()
    assert [tuple(r) for r in got] == expected


def draws(spark, seed, n):
    df = spark.range(1, n + 1).select("id", draw48(seed, F.col("id")).alias("a"), draw32(seed, F.col("id"), 2).alias("b"))
    return {r.id: (r.a, r.b) for r in df.collect()}


def replay_reservoir(users, k, seed, table):
    sample, out = [None] * k, []
    for n, user in enumerate(users, 1):
        accept, slot = table[n]
        if n <= k:
            sample[n - 1] = (user, n)
        elif accept < k * 2**48 // n:
            sample[slot % k] = (user, n)
        out.append(list(sample))
    return out


def test_reservoir_and_snapshots(spark):
    users, k, seed, size = make_users(3), 40, 17, 100
    states = replay_reservoir(users, k, seed, draws(spark, seed, len(users)))
    stream = as_stream(spark, users)
    got = {r.slot: (r.user, r.n) for r in reservoir(stream, k, seed).collect()}
    assert got == dict(enumerate(states[-1]))
    assert any(n > k for _, n in states[-1])
    shots = reservoir_snapshots(stream, k, size, seed, slots=(0, 10, 39)).orderBy("batch").collect()
    ends = [min(s + size, len(users)) for s in range(0, len(users), size)]
    assert [tuple(r) for r in shots] == [
        (b, end, *(states[end - 1][s][0] for s in (0, 10, 39))) for b, end in enumerate(ends)
    ]


def test_bootstrap_batches_draw_with_replacement(spark):
    df = spark.range(50).select("id", (F.col("id") * 2).alias("v"))
    rows = bootstrap_batches(df, "id", 40, 5, seed=3).collect()
    assert Counter(r.batch for r in rows) == {b: 40 for b in range(5)}
    assert all(r.v == 2 * r.id for r in rows)
    assert 40 < len({r.id for r in rows}) <= 50
    again = bootstrap_batches(df.repartition(7), "id", 40, 5, seed=3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_streams_equal_batches(spark, tmp_path):
    users = make_users(4, n=400)
    rng = random.Random(0)
    numberedrows = list(enumerate(users))
    rng.shuffle(numberedrows)  # arrival order of files must not matter
    source = str(tmp_path / "source")
    for i in range(4):
        part = spark.createDataFrame(numberedrows[i::4], "seq bigint, who string")
        part.coalesce(1).write.mode("append").parquet(source)
    batch = numbered(spark.read.parquet(source), "seq", "who")

    def stream():
        return numbered(read_stream(spark, source, "seq bigint, who string", files_per_trigger=1), "seq", "who")

    family = compact_family()
    fm = stream_fm(stream(), 100, family, str(tmp_path / "fm"))
    assert sorted(map(tuple, fm.collect())) == sorted(map(tuple, fm_estimate(batch, 100, family).collect()))
    kept = stream_reservoir(stream(), 30, 5, str(tmp_path / "kept"))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, reservoir(batch, 30, 5).collect()))
    first = stream_first_arrivals(stream(), str(tmp_path / "first"))
    batches = spark.range(4).select(F.col("id").alias("batch"))
    rates = false_positive_rates(bloom_outcomes(first, family), batches, 100)
    assert sorted(map(tuple, rates.collect())) == sorted(map(tuple, bloom_fpr(batch, 100, family).collect()))


def test_reservoir_of_very_long_streams(spark):
    late = spark.range(3 * 10**9, 3 * 10**9 + 1000).union(spark.range(10**12, 10**12 + 1000)).select(F.col("id").alias("n"), F.lit("u").alias("user"))
    assert replacements(late, 50, 7).count() == 0
    early = spark.range(1, 2001).select(F.col("id").alias("n"), F.lit("u").alias("user"))
    assert 120 < replacements(early, 50, 7).count() < 360  # about 50 (1 + ln 40)
