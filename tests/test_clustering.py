from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from oremill.functions.vectors import centroid, mahalanobis, variance
from oremill.operators.clustering import (
    Summaries,
    assign,
    bfr,
    cluster_summary,
    merge_pairs,
    split_singletons,
    with_chunk,
)


def frame(spark, x, labels=None):
    labels = labels if labels is not None else [0] * len(x)
    rows = [(i, [float(v) for v in p], int(c)) for i, (p, c) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "id bigint, features array<double>, cluster int")


def blobs(seed=0, per=80, centres=((0, 0, 0), (40, 0, 0), (0, 40, 0)), spread=1.0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, spread, size=(per, 3)) for c in centres])
    return x, np.repeat(np.arange(len(centres)), per)


def brute_distance(x, members):
    n = len(members)
    centre = members.sum(axis=0) / n
    spread = (members**2).sum(axis=0) / n - centre**2
    return np.inf if (spread <= 0).any() else float(np.sqrt((((x - centre) ** 2) / spread).sum()))


def test_summary_and_distance(spark):
    x, labels = blobs(per=20)
    df = frame(spark, x, labels)
    summary = cluster_summary(df)
    got = Summaries.collect(summary)
    for c in range(3):
        members = x[labels == c]
        assert got.n[c] == len(members)
        assert got.sum[c] == pytest.approx(members.sum(axis=0))
        assert got.sumsq[c] == pytest.approx((members**2).sum(axis=0))
    measured = df.drop("cluster").join(F.broadcast(summary.where("cluster = 1")), F.lit(True)).select(
        "id",
        mahalanobis(
            F.col("features"),
            centroid(F.col("sum"), F.col("n")),
            variance(F.col("sum"), F.col("sumsq"), F.col("n")),
        ).alias("d"),
    )
    for r in measured.collect():
        assert r.d == pytest.approx(brute_distance(x[r.id], x[labels == 1]))


def test_flat_cluster_is_infinitely_far(spark):
    x = np.array([[1.0, 2.0], [1.0, 3.0], [1.0, 4.0], [5.0, 5.0]])
    summary = cluster_summary(frame(spark, x[:3]))
    model = Summaries.collect(summary)
    assert np.isinf(model.distances(x)).all()
    assert assign(frame(spark, x).drop("cluster"), model).where("cluster is not null").count() == 0


def test_assign_is_strict_argmin(spark):
    x, labels = blobs(seed=1, per=30)
    model = Summaries.collect(cluster_summary(frame(spark, x, labels)))
    probes = np.array([[0.5, 0.1, 0.0], [39.0, 1.0, 0.5], [500.0, 500.0, 500.0]])
    got = {r.id: (r.cluster, r.distance) for r in assign(frame(spark, probes).drop("cluster"), model, 2.0).collect()}
    for i, p in enumerate(probes):
        distances = [brute_distance(p, x[labels == c]) for c in range(3)]
        assert got[i][1] == pytest.approx(min(distances))
        near = int(np.argmin(distances)) if min(distances) < 2 * np.sqrt(3) else None
        assert got[i][0] == near
    assert [got[i][0] for i in range(3)] == [0, 1, None]


def test_merge_pairs_measures_both_directions(spark):
    x, labels = blobs(seed=2, per=25, centres=((0, 0, 0), (1, 0, 0), (90, 0, 0)))
    rows = merge_pairs(cluster_summary(frame(spark, x, labels))).collect()
    assert {(r.a, r.b) for r in rows} == {(0, 1), (0, 2), (1, 2)}
    for r in rows:
        a, b = x[labels == r.a], x[labels == r.b]
        assert r.a_to_b == pytest.approx(brute_distance(a.mean(axis=0), b))
        assert r.b_to_a == pytest.approx(brute_distance(b.mean(axis=0), a))
        assert r.mergeable == (min(r.a_to_b, r.b_to_a) < 2 * np.sqrt(3))
    assert {(r.a, r.b) for r in rows if r.mergeable} == {(0, 1)}


def test_split_singletons(spark):
    df = frame(spark, np.zeros((4, 1)), [0, 0, 1, 2])
    groups, alone = split_singletons(df)
    assert {r.id for r in groups.collect()} == {0, 1}
    assert {r.id for r in alone.collect()} == {2, 3}


def test_chunks_partition_the_points(spark):
    x, labels = blobs(per=100)
    counts = {r["chunk"]: r["count"] for r in with_chunk(frame(spark, x), 5, 1).groupBy("chunk").count().collect()}
    assert set(counts) == set(range(5)) and sum(counts.values()) == 300


def test_bfr_recovers_blobs_and_accounts_for_every_point(spark):
    x, truth = blobs(seed=3, per=600)
    far = np.array([[400.0, 400.0, 400.0], [-400.0, 300.0, 10.0], [10.0, -500.0, 250.0]])
    points = frame(spark, np.concatenate([x, far])).drop("cluster")
    rounds, labels = bfr(points, k=3, chunks=5, seed=5, max_iter=3, first_pass_clusters=12)
    got = {r.id: r.cluster for r in labels.collect()}
    assert len(got) == labels.count() == len(x) + len(far)
    table = rounds.orderBy("round").collect()
    assert [r["round"] for r in table] == [1, 2, 3, 4, 5]
    last = table[-1]
    assert last.ds_points + last.cs_points + last.rs_points == len(x) + len(far)
    assert last.ds_points == sum(c >= 0 for c in got.values())
    assert all(a.ds_points <= b.ds_points for a, b in zip(table, table[1:]))
    by_cluster = defaultdict(Counter)
    for i, c in got.items():
        if c >= 0 and i < len(truth):
            by_cluster[c][int(truth[i])] += 1
    agreeing = sum(max(c.values()) for c in by_cluster.values())
    assert agreeing >= 0.85 * len(truth)


def test_bfr_keeps_compression_sets_counted(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(260, 4))
    rounds, labels = bfr(frame(spark, x).drop("cluster"), k=2, alpha=0.6, seed=2, max_iter=3, first_pass_clusters=8)
    assert labels.count() == labels.select("id").distinct().count() == 260
    seen = 0
    table = rounds.orderBy("round").collect()
    assert table[-1].ds_points + table[-1].cs_points + table[-1].rs_points == 260
    assert any(r.cs_clusters > 0 for r in table)
    for r in table:
        total = r.ds_points + r.cs_points + r.rs_points
        assert total > seen
        seen = total
    assert labels.where("cluster >= 0").count() == table[-1].ds_points
