"""Streams that judge and close their batches while they run."""

import random

import pytest
from pyspark.sql import functions as F

from oremill.functions.hashing import compact_family
from oremill.operators import sampling, sketches
from oremill.streaming import closing
from oremill.streaming.summaries import read_stream

SIZE = 20


def arrivals(n, users, seed=1):
    rng = random.Random(seed)
    return [(i + 1, str(rng.randrange(users))) for i in range(n)]


def arrive(spark, rows, folder):
    spark.createDataFrame(rows, "n bigint, user string").coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)


@pytest.mark.parametrize("disorder", [False, True])
def test_bloom_verdicts_over_restarts(spark, tmp_path, disorder):
    rows = arrivals(210, 400)
    family = compact_family()
    want = sketches.bloom_fpr(spark.createDataFrame(rows, "n bigint, user string"), SIZE, family).orderBy("batch").collect()
    order = list(rows)
    if disorder:
        random.Random(2).shuffle(order)
    feed, folder = f"{tmp_path}/feed", str(tmp_path)
    for at in range(0, 210, 70):  # three micro-batches, each by a query of its own
        arrive(spark, order[at : at + 70], feed)
        closing.stream_bloom(source(spark, feed), SIZE, family, folder)
        judged = closing.bloom_tables(spark, folder).before("rates").collect()
        known = {r.batch: (r.fp, r.tn) for r in want}
        assert all((r.fp, r.tn) == known[r.batch] for r in judged)  # what is out does not change
        if not disorder:
            assert len(judged) == (at + 70) // SIZE
    assert closing.bloom_rates(spark, SIZE, family, folder).orderBy("batch").collect() == want


def test_a_version_without_its_mark_is_judged_again(spark, tmp_path):
    rows, family = arrivals(60, 30), compact_family()
    arrive(spark, rows, f"{tmp_path}/feed")
    tables = closing.bloom_tables(spark, str(tmp_path))
    tables.write(spark.createDataFrame([(0, 99, 99)], "batch bigint, fp bigint, tn bigint"), "rates", 0)  # left by a lost driver
    closing.stream_bloom(source(spark, f"{tmp_path}/feed"), SIZE, family, str(tmp_path))
    want = sketches.bloom_fpr(spark.createDataFrame(rows, "n bigint, user string"), SIZE, family).orderBy("batch").collect()
    assert closing.bloom_rates(spark, SIZE, family, str(tmp_path)).orderBy("batch").collect() == want


def test_windows_close_and_their_state_goes(spark, tmp_path):
    rows = arrivals(8 * 5 * SIZE, 50)
    feed = f"{tmp_path}/feed"
    for at in range(0, len(rows), 5 * SIZE):
        arrive(spark, rows[at : at + 5 * SIZE], feed)
    arrive(spark, [(closing.CLOSING, None)], feed)
    stream = closing.clocked(source(spark, feed), SIZE).groupBy(closing._batch_window(SIZE)).agg(F.count("*").alias("rows"))
    query = closing.run(stream, f"{tmp_path}/count", lambda found, version: found.write.format("noop").mode("overwrite").save())
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 8 and max(held) <= 5 + 3  # the windows of one file and of the delay, however long the stream

    table = spark.createDataFrame(rows, "n bigint, user string")
    fm = closing.stream_fm_batches(source(spark, feed), SIZE, compact_family(), f"{tmp_path}/fm", late=SIZE)
    assert fm.orderBy("batch").collect() == sketches.fm_estimate(table, SIZE, compact_family()).orderBy("batch").collect()
    slots = (0, 3, 9)
    shots = closing.stream_snapshots(source(spark, feed), 10, SIZE, 7, f"{tmp_path}/shots", late=SIZE, slots=slots)
    want = sampling.reservoir_snapshots(table, 10, SIZE, 7, slots)
    assert shots.orderBy("batch").collect() == want.orderBy("batch").collect()


def test_streamed_draws_equal_the_batch(spark, tmp_path):
    table = spark.range(37).select(F.col("id").alias("place"), (F.col("id") * 3).alias("value"))
    for at in range(0, 120, 40):
        spark.range(at, at + 40).select(F.col("id").alias("draw")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    draws = read_stream(spark, f"{tmp_path}/feed", spark.read.parquet(f"{tmp_path}/feed").schema, files_per_trigger=1)
    found = closing.stream_bootstrap(draws, table, "place", 37, 10, 5, str(tmp_path))
    want = sampling.bootstrap_batches(table, "place", 10, 12, 5)
    assert sorted(tuple(r[c] for c in want.columns) for r in found.collect()) == sorted(tuple(r) for r in want.collect())
