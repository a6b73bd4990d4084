import random

import pytest
from pyspark.sql import functions as F

from oremill.operators.matching import first_fit
from oremill.operators.numbering import ranks_within, row_numbers


def walked(pairs):
    used, out = set(), set()
    for a, b in sorted(set(pairs)):
        if a < b and not {a, b} & used:
            used |= {a, b}
            out.add((a, b))
    return out


@pytest.mark.parametrize("share, ends, heads", [(0.02, 500, 256), (1.0, 60, 256), (0.3, 80, 7), (0.0, 5, 256)])
def test_first_fit_equals_the_walk(spark, share, ends, heads):
    rng = random.Random(ends)
    pairs = [(a, b) for a in range(ends) for b in range(a + 1, ends) if rng.random() < share]
    rows = pairs + pairs[:3] + [(7, 7), (9, 2)]
    found = first_fit(spark.createDataFrame(rows, "a int, b int").repartition(3), heads)
    assert {(r.a, r.b) for r in found.collect()} == walked(pairs)
    assert found.count() == len(walked(pairs))


def test_row_numbers_and_ranks_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(50), i) for i in rng.sample(range(100_000), 3000)]
    df = spark.createDataFrame(rows, "g int, v int").repartition(7)
    numbers = {(r.g, r.v): r.n for r in row_numbers(df, "g", F.desc("v")).collect()}
    order = sorted(rows, key=lambda r: (r[0], -r[1]))
    assert numbers == {row: i + 1 for i, row in enumerate(order)}
    ranked = ranks_within(df, ["g"], "v").collect()
    members = {}
    for g, v in sorted(rows):
        members.setdefault(g, []).append(v)
    assert all(members[r.g][r["rank"] - 1] == r.v and r.size == len(members[r.g]) for r in ranked)
    assert len(ranked) == len(rows)
    assert row_numbers(df.limit(0), "v").collect() == []
