import random
from collections import Counter
from datetime import date
from itertools import combinations

import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from oremill.operators.baskets import basket_rows, basket_sets, item_support, longer_than, scaled_support
from oremill.operators.itemsets import (
    MASK_BITS,
    _tails,
    count_itemsets,
    frequent_itemsets,
    local_thresholds,
    son_candidates,
    son_itemsets,
)
from oremill.queries import _retail_text
from oremill.sources import readers

def brute(baskets, support, most=99):
    """All frequent itemsets by enumerating every subset of every basket."""
    counts = Counter()
    for items in baskets.values():
        for k in range(1, min(len(items), most) + 1):
            counts.update(combinations(sorted(items), k))
    return {c: n for c, n in counts.items() if n >= support}


def as_rows(spark, baskets):
    pairs = [(str(k), i) for k, items in baskets.items() for i in items]
    return spark.createDataFrame(pairs, "key string, item string")


def random_baskets(seed, n=60, vocabulary=12, longest=8):
    rng = random.Random(seed)
    names = [f"i{v:02d}" for v in range(vocabulary)]
    out = {}
    for key in range(n):
        # squared uniform draw: low-numbered items are hot
        picked = {names[int(vocabulary * rng.random() ** 2)] for _ in range(rng.randint(1, longest))}
        out[key] = sorted(picked)
    return out


def collect(df):
    rows = df.collect()
    out = {tuple(r.itemset): r.support for r in rows}
    assert len(out) == len(rows)
    return out


def test_basket_rows_are_distinct_and_null_free(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), (None, "y"), ("b", "y")], "k string, i string")
    assert sorted(map(tuple, basket_rows(df, "k", "i").collect())) == [("a", "x"), ("b", "y")]
    assert sorted(map(tuple, basket_rows(df, "i", "k").collect())) == [("x", "a"), ("y", "b")]


def test_basket_sets_hold_bounded_ranges(spark):
    named = {"long": [f"{i:03d}" for i in range(100)], "full": list("abcd"), "short": ["b", "a"]}
    rows = as_rows(spark, named)
    whole = basket_sets(rows).collect()
    assert {(r.key, r.part, tuple(r["items"]), r["size"]) for r in whole} == {(k, 0, tuple(sorted(v)), len(v)) for k, v in named.items()}
    cut = {(r.key, r.part): r for r in basket_sets(rows, length=4).collect()}
    assert set(cut) == {("full", 0), ("short", 0)} | {("long", p) for p in range(25)}
    for (key, part), r in cut.items():
        assert r["items"] == sorted(named[key])[4 * part : 4 * part + 4] and r["size"] == len(named[key])


def test_strict_size_filter_and_support(spark):
    rows = as_rows(spark, {"a": "xyz", "b": "xy", "c": "x"})
    assert {r.key for r in longer_than(rows, 2).collect()} == {"a"}
    assert {(r.item, r.support) for r in item_support(rows, 2).collect()} == {("x", 3), ("y", 2)}


@pytest.mark.parametrize("support", [4])
def test_overlapping_baskets_match_enumeration(spark, support):
    baskets = random_baskets(3, n=13, longest=10)
    assert collect(frequent_itemsets(as_rows(spark, baskets), support)) == brute(baskets, support)


@pytest.mark.parametrize("long_basket", [1, 3])
def test_long_baskets_are_counted_exactly(spark, long_basket):
    baskets = random_baskets(7)
    baskets["huge"] = sorted({f"i{v:02d}" for v in range(12)} | {f"only{v}" for v in range(3)})
    got = collect(frequent_itemsets(as_rows(spark, baskets), 5, long_basket=long_basket))
    assert got == brute(baskets, 5)


def test_support_one_keeps_every_subset(spark):
    baskets = {"a": list("wxyz"), "b": list("xy")}
    assert collect(frequent_itemsets(as_rows(spark, baskets), 1, long_basket=2)) == brute(baskets, 1)


def test_agrees_with_fpgrowth(spark):
    baskets = random_baskets(11, n=80)
    rows = as_rows(spark, baskets)
    arrays = rows.groupBy("key").agg(F.collect_set("item").alias("items"))
    n = len(baskets)
    model = FPGrowth(itemsCol="items", minSupport=(6 - 0.5) / n, minConfidence=1.0).fit(arrays)
    other = {tuple(sorted(r["items"])): r.freq for r in model.freqItemsets.collect()}
    assert collect(frequent_itemsets(rows, 6)) == other


def test_no_frequent_item(spark):
    assert frequent_itemsets(as_rows(spark, {"a": "x", "b": "y"}), 2).count() == 0


def test_count_itemsets_is_exact_for_any_candidates(spark):
    baskets = random_baskets(3)
    baskets["huge"] = [f"i{v:02d}" for v in range(12)]
    asked = [["i01"], ["i00", "i01"], ["i03", "i00", "i05"], ["i00", "i01", "i02", "i03"], ["i00", "nope"], ["i11", "i10"]]
    itemsets = spark.createDataFrame([(a,) for a in asked], "itemset array<string>")
    for long_basket in (2, 256):
        got = collect(count_itemsets(as_rows(spark, baskets), itemsets, long_basket))
        assert got == {
            tuple(sorted(a)): sum(set(a) <= set(b) for b in baskets.values()) for a in asked
        }


@pytest.mark.parametrize("parts,long_basket", [(1, 256), (3, 2)])
def test_two_pass_search(spark, parts, long_basket):
    baskets = random_baskets(5)
    rows = as_rows(spark, baskets)
    part = F.pmod(F.col("key").cast("bigint"), F.lit(parts))
    candidates, frequent = son_itemsets(rows, 6, part, long_basket)
    assert collect(frequent) == brute(baskets, 6)
    expected = Counter()
    for p in range(parts):
        local = {k: v for k, v in baskets.items() if k % parts == p}
        expected.update(brute(local, -(-len(local) * 6 // len(baskets))).keys())
    assert {tuple(r.itemset): r.parts for r in candidates.collect()} == dict(expected)


def test_local_thresholds_round_up(spark):
    rows = spark.createDataFrame([(p, k, "x") for p, k in [(0, 1), (0, 2), (0, 3), (1, 4)]], "part long, key long, item string")
    assert {(r.part, r.need) for r in local_thresholds(rows, 3).collect()} == {(0, 3), (1, 1)}
    assert son_candidates(rows.drop("part"), 2, F.col("key") % 2).count() == 1


def test_scaled_support_does_not_overflow(spark):
    got = spark.range(1).select(F.lit(6 * 10**10).alias("n")).select(scaled_support("n", 10**9, 25 * 10**10).alias("s")).first().s
    assert got == 240_000_000


def test_broken_retail_lines_are_listed_with_reasons(spark, tmp_path):
    lines = [
        "date,customer,c2,c3,c4,product",
        '"01/02/2000","7","-","1","","0000012"',
        '"01/02/2000","7","-","1","","twelve"',
        '"01/02/2000","7","-","1",""',
        '"01/02/2000","7","-","1","","5","6"',
        '"","7","-","1","","5"',
        '"01/02/2000"," ","-","1","","5"',
        '"01/02/2000","8","-","1","","99999999999999999999999"',
    ]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(f"{tmp_path}/retail")
    kept = readers.read_retail_csv(spark, f"{tmp_path}/retail").collect()
    assert [(r.key, r["item"]) for r in kept] == [("01/02/2000-7", "12")]
    rejects = [(r.reason, r["line"]) for r in readers.retail_rejects(spark, f"{tmp_path}/retail").collect()]
    reasons = ["product", "columns", "columns", "key", "key", "product"]
    assert sorted(r for r, _ in rejects) == sorted(reasons)
    assert {text for reason, text in rejects if reason == "columns"} == {lines[3], lines[4]}


@pytest.mark.parametrize("broken", [False, True])
def test_retail_files_follow_the_partitions(spark, tmp_path, broken):
    orders = [(k, date(2020, 1, 1 + k % 28), k % 7 if k % 11 else None) for k in range(300)]
    lines = [(k, 1000 + k if k % 13 else None, n) for k in range(300) for n in (1, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate date, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    settings = {"adaptive.enabled": "false", "shuffle.partitions": "9", "autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(f"spark.sql.{name}") for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(f"spark.sql.{name}", value)
        path = _retail_text(spark, str(tmp_path), broken)
        written = spark.read.text(path).select("_metadata.file_path", "value").collect()
    finally:
        for name, value in before.items():
            spark.conf.set(f"spark.sql.{name}", value)
    files = {r.file_path for r in written}
    header = "date,customer,c2,c3,c4,product"
    assert len(files) == 9 and sum(r.value == header for r in written) == 9
    assert len(written) - 9 == sum(part is not None for _, part, _ in lines) + (sum(k % 83 == 0 and part is None for k, part, _ in lines) if broken else 0)
    if not broken:
        got = {(r.key, r.item) for r in readers.read_retail_csv(spark, path).collect()}
        by_key = {k: (d, c) for k, d, c in orders}
        assert got >= {
            (f"{by_key[k][0]:%m/%d/%Y}-{by_key[k][1]}", str(part)) for k, part, _ in lines if part is not None and by_key[k][1] is not None
        }


@pytest.mark.parametrize("n_codes", [MASK_BITS, MASK_BITS + 1])
def test_equal_baskets_are_merged_whether_codes_fit_in_a_long_or_not(spark, n_codes):
    rows = [(p, k, c) for p in (0, 1) for k, codes in enumerate([(0, 5, 61), (61, 5, 0), (3,), (60, 61)]) for c in codes]
    tails = _tails(spark.createDataFrame(rows, "part int, key int, code bigint"), n_codes)
    expected = {(p, codes, n) for p in (0, 1) for codes, n in (((0, 5, 61), 2), ((60, 61), 1))}
    assert {(r.part, tuple(r.tail), r.weight) for r in tails.collect()} == expected
    if n_codes <= MASK_BITS:  # lists are neither built nor sorted for each basket
        assert "collect_list" not in tails._jdf.queryExecution().toString()


@pytest.mark.parametrize("vocabulary", [MASK_BITS, MASK_BITS + 8])
def test_itemsets_of_many_items(spark, vocabulary):
    rng = random.Random(vocabulary)
    baskets = {k: {f"i{v:02d}" for v in rng.sample(range(vocabulary), 5)} for k in range(200)}
    got = {tuple(r.itemset): r.support for r in frequent_itemsets(as_rows(spark, baskets), 3).collect()}
    assert got == brute(baskets, 3)
