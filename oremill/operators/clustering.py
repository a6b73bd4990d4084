"""Clustering in one pass over chunks with discard, compression and retained sets.

Points are ``(id, features array<double>)``.  A cluster is summarised by its
count, vector sum and vector sum of squares.  Only such summaries reach the
driver; their number is set by ``k`` and not by the data, just like the centres
of a K-Means model.  Points, memberships and retained points stay in DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.functions import vectors as vec
from oremill.functions.hashing import draw32
from oremill.operators.matching import first_fit
from oremill.operators.numbering import row_numbers
from oremill.plans.staging import stage, stage_counted

SUMMARY_SCHEMA = "cluster int, n bigint, sum array<double>, sumsq array<double>"
FIRST_PASS_FACTOR = 25
RETAINED_FACTOR = 3


def as_points(df: DataFrame, id_column: str, features: str) -> DataFrame:
    return df.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(features).cast("array<double>").alias("features")
    ).dropna()


def with_chunk(points: DataFrame, chunks: int, seed: int) -> DataFrame:
    """Add ``chunk``: a uniform random split that needs no global row numbering."""
    return points.withColumn("chunk", (draw32(seed, F.col("id")) % F.lit(chunks)).cast("int"))


def with_file_chunk(points: DataFrame, chunks: int, *order: str) -> DataFrame:
    """Add ``row_number`` and ``chunk``: ``ceil(rows / chunks)`` rows each, in the given order (``id`` by default)."""
    numbered = stage(row_numbers(points, *(order or ("id",)), name="row_number"), "numbered")
    total = numbered.count()
    size = max(1, -(-total // chunks))
    return numbered.withColumn("chunk", F.expr(f"cast((row_number - 1) div {size} as int)"))


def kmeans_labels(points: DataFrame, k: int, seed: int, max_iter: int = 20) -> DataFrame:
    """``points`` with ``cluster`` from Spark ML's K-Means."""
    vectors = points.withColumn("_vector", array_to_vector("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_vector", predictionCol="cluster").fit(
        vectors.select("_vector")
    )
    return model.transform(vectors).drop("_vector")


def seeded_labels(points: DataFrame, k: int) -> DataFrame:
    """``points`` with the ``cluster`` of the nearest of the ``k`` points of smallest id, the smaller of equals.

    The assignment step of K-Means for fixed seeds; clusters are numbered by seed id.
    """
    seeds = points.orderBy("id").limit(k).select("features").collect()
    centres = np.array([r["features"] for r in seeds])

    @F.pandas_udf("int")
    def nearest(features: pd.Series) -> pd.Series:
        x = np.stack(features.to_numpy()) if len(features) else np.zeros((0, centres.shape[-1]))
        away = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1) if len(x) else np.zeros((0, 1))
        return pd.Series(away.argmin(axis=1), dtype="int32")

    return points.withColumn("cluster", nearest("features"))


def cluster_summary(labelled: DataFrame, *by: str) -> DataFrame:
    """``(*by, n, sum, sumsq)`` per cluster; ``by`` defaults to ``cluster``."""
    by = by or ("cluster",)
    sums = labelled.select(
        *by,
        array_to_vector("features").alias("_x"),
        array_to_vector(F.transform("features", lambda x: x * x)).alias("_xx"),
    )
    return (
        sums.groupBy(*by)
        .agg(F.count("*").alias("n"), Summarizer.sum(F.col("_x")).alias("_s"), Summarizer.sum(F.col("_xx")).alias("_q"))
        .select(*by, "n", vector_to_array("_s").alias("sum"), vector_to_array("_q").alias("sumsq"))
    )


@dataclass(frozen=True)
class Summaries:
    """Cluster summaries as arrays, in cluster order."""

    ids: np.ndarray
    n: np.ndarray
    sum: np.ndarray
    sumsq: np.ndarray

    @classmethod
    def collect(cls, summary: DataFrame) -> Summaries:
        rows = summary.select("cluster", "n", "sum", "sumsq").orderBy("cluster").collect()
        return cls(
            np.array([r["cluster"] for r in rows], dtype=np.int64),
            np.array([r["n"] for r in rows], dtype=np.int64),
            np.array([r["sum"] for r in rows], dtype=float),
            np.array([r["sumsq"] for r in rows], dtype=float),
        )

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def centroids(self) -> np.ndarray:
        return self.sum / self.n[:, None]

    @property
    def variances(self) -> np.ndarray:
        return self.sumsq / self.n[:, None] - self.centroids**2

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Mahalanobis distance of each row of ``x`` to each cluster.

        Infinite for a cluster with a dimension of zero variance (or below zero
        by rounding).
        """
        out = np.empty((len(x), len(self)))
        centroids, variances = self.centroids, self.variances
        for i in range(len(self)):
            if (variances[i] <= 0).any():
                out[:, i] = np.inf
            else:
                out[:, i] = np.sqrt((((x - centroids[i]) ** 2) / variances[i]).sum(axis=1))
        return out


def nearest(features: str | Column, clusters: Summaries) -> Column:
    """``struct<cluster, distance>`` of the nearest cluster; the lowest id wins ties."""

    @F.pandas_udf("cluster int, distance double")
    def measure(batch: pd.Series) -> pd.DataFrame:
        distances = clusters.distances(np.stack(batch.to_numpy()))
        best = distances.argmin(axis=1)
        return pd.DataFrame({"cluster": clusters.ids[best], "distance": distances[np.arange(len(best)), best]})

    return measure(features)


def assign(points: DataFrame, clusters: Summaries, alpha: float = 2.0) -> DataFrame:
    """``points`` with ``cluster`` and ``distance``.

    ``cluster`` is null unless the distance is below ``alpha * sqrt(dimensions)``.
    """
    measured = points.withColumn("_near", nearest("features", clusters))
    close = F.col("_near.distance") < F.lit(alpha) * F.sqrt(F.size("features"))
    return measured.withColumns(
        {"cluster": F.when(close, F.col("_near.cluster")), "distance": F.col("_near.distance")}
    ).drop("_near")


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two summary tables with their columns told apart, for joins of a few rows with a few."""
    names = ("cluster", "n", "sum", "sumsq")
    return left.select(*[F.col(c).alias(f"a_{c}") for c in names]), right.select(*[F.col(c).alias(f"b_{c}") for c in names])


def _towards(one: str, other: str) -> Column:
    """Distance of one cluster's centroid in the metric of the other."""
    total, squares, n = F.col(f"{other}_sum"), F.col(f"{other}_sumsq"), F.col(f"{other}_n")
    here = vec.centroid(F.col(f"{one}_sum"), F.col(f"{one}_n"))
    return vec.mahalanobis(here, vec.centroid(total, n), vec.variance(total, squares, n))


def _are_close(alpha: float) -> Column:
    return F.least("a_to_b", "b_to_a") < F.lit(alpha) * F.sqrt(F.size("a_sum"))


def merge_pairs(summary: DataFrame, alpha: float = 2.0) -> DataFrame:
    """``(a, b, a_to_b, b_to_a, mergeable)`` for clusters ``a < b``.

    Distances run from the centroid of one cluster in the metric of the other.
    The number of clusters is a model parameter, not a data size.
    """
    a, b = _sides(summary, summary)
    met = a.join(b, F.col("a_cluster") < F.col("b_cluster"))
    measured = met.withColumns({"a_to_b": _towards("a", "b"), "b_to_a": _towards("b", "a")})
    return measured.select(
        F.col("a_cluster").alias("a"), F.col("b_cluster").alias("b"), "a_to_b", "b_to_a", _are_close(alpha).alias("mergeable")
    )


def added_up(summaries: DataFrame) -> DataFrame:
    """Summaries of equal clusters added."""
    vectors = summaries.select("cluster", "n", array_to_vector("sum").alias("_s"), array_to_vector("sumsq").alias("_q"))
    return (
        vectors.groupBy("cluster")
        .agg(F.sum("n").alias("n"), Summarizer.sum(F.col("_s")).alias("_s"), Summarizer.sum(F.col("_q")).alias("_q"))
        .select("cluster", "n", vector_to_array("_s").alias("sum"), vector_to_array("_q").alias("sumsq"))
    )


def merge_targets(summary: DataFrame, alpha: float = 2.0) -> DataFrame:
    """``(cluster, into)`` for every cluster.

    In the order of their ids, each cluster that is still free takes up the first later
    free one that is close, judged by the summaries as they came; it takes one at most,
    and is not looked at again.  ``into`` is the cluster itself unless it was taken up.
    """
    taken = first_fit(merge_pairs(summary, alpha).where("mergeable"))
    return summary.select("cluster").join(taken, summary["cluster"] == taken["b"], "left").select(
        "cluster", F.coalesce("a", "cluster").alias("into")
    )


def discard_targets(summary: DataFrame, discard: DataFrame, alpha: float = 2.0) -> DataFrame:
    """``(cluster, into)``: the first discard cluster that is close, for clusters that have one.

    Discard clusters are taken as they came, so the order of the clusters does not matter.
    """
    a, b = _sides(summary, discard)
    measured = a.crossJoin(b).withColumns({"a_to_b": _towards("a", "b"), "b_to_a": _towards("b", "a")})
    return measured.where(_are_close(alpha)).groupBy(F.col("a_cluster").alias("cluster")).agg(F.min("b_cluster").alias("into"))


def moved(summary: DataFrame, targets: DataFrame) -> DataFrame:
    """The summaries of the clusters in ``targets`` under their new clusters, added up."""
    return added_up(summary.join(targets, "cluster").select(F.col("into").alias("cluster"), "n", "sum", "sumsq"))


def split_singletons(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(groups, singletons)``: points of clusters with several members, and with one."""
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("members"))
    sized = labelled.join(F.broadcast(sizes), "cluster")  # one short row a cluster, as many as the model has
    return (
        sized.where(F.col("members") > 1).drop("members"),
        sized.where(F.col("members") == 1).drop("members"),
    )


def bfr(
    points: DataFrame,
    k: int,
    chunks: int = 5,
    alpha: float = 2.0,
    seed: int = 553,
    max_iter: int = 20,
    first_pass_clusters: int | None = None,
    clusterer: Callable[[DataFrame, int], DataFrame] | None = None,
    chunker: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Returns ``(rounds, labels)``.

    ``rounds`` is ``(round, ds_points, cs_clusters, cs_points, rs_points)`` after
    each chunk; ``labels`` is ``(id, cluster)`` with -1 for points that ended in
    the compression or retained set.

    Outliers are the singletons of a first clustering of chunk 0 into
    ``first_pass_clusters`` (25 k by default) clusters.  A chunk 0 with fewer points,
    or with fewer than ``k`` points besides outliers, is an error.  A retained set
    of no more points than the clusters it should fall into stays as it is.
    ``clusterer`` labels points with ``k`` clusters; by default it is Spark ML's
    K-Means with at most ``max_iter`` iterations.

    ``chunker`` adds a column ``chunk`` (from 0) to the points; by default a random split.

    Within a chunk, points are compared with the discard set as it was when the
    chunk began, and its summaries are updated once at the end, so the result
    does not depend on the order of points.  Centroids are always ``sum / n``,
    and a merged compression cluster is kept.  After the last chunk compression
    clusters join the discard set as it is then.
    """
    spark = points.sparkSession
    clusterer = clusterer or (lambda found, n: kmeans_labels(found, n, seed, max_iter))
    chunker = chunker or (lambda found: with_chunk(found, chunks, seed))
    chunked = stage(chunker(points).select("id", "features", "chunk"), "points", by="chunk")

    def chunk(i: int) -> DataFrame:
        return chunked.where(F.col("chunk") == i).select("id", "features")

    fine = first_pass_clusters or FIRST_PASS_FACTOR * k
    n_first = chunk(0).count()
    if n_first < fine:
        raise ValueError(f"the first chunk has {n_first} points for {fine} clusters: lower first_pass_clusters")
    first = stage(clusterer(chunk(0), fine), "peel")
    body, outliers = split_singletons(first)
    body, n_body = stage_counted(body.drop("cluster"), "body")
    if n_body < k:
        raise ValueError(f"only {n_body} points of the first chunk are no outliers: lower first_pass_clusters")
    labelled = stage(clusterer(body, k), "discard")
    discard = stage(cluster_summary(labelled), "summary")
    discard_members = [labelled.select("id", "cluster")]
    retained, n_retained = stage_counted(outliers.select("id", "features"), "retained")
    # Compression clusters: their summaries, their points by first cluster, and where each first cluster is now.
    compressed = spark.createDataFrame([], SUMMARY_SCHEMA)
    compressed_members: list[DataFrame] = []
    owners = spark.createDataFrame([], "cluster int, owner int")
    next_id = 0
    rounds: list[DataFrame] = []

    def recluster(n_clusters: int) -> None:
        """Cluster the retained set: groups join the compression set, singletons stay."""
        nonlocal retained, n_retained, compressed, owners, next_id
        if n_retained <= n_clusters:
            return
        groups, alone = split_singletons(stage(clusterer(retained, n_clusters), "recluster"))
        fresh = stage(groups.withColumn("cluster", F.col("cluster") + F.lit(next_id)), "compressed")
        compressed_members.append(fresh.select("id", "cluster"))
        compressed = stage(compressed.unionByName(cluster_summary(fresh)), "summary")
        owners = owners.unionByName(compressed.where(F.col("cluster") >= next_id).select("cluster", F.col("cluster").alias("owner")))
        next_id += n_clusters
        retained, n_retained = stage_counted(alone.select("id", "features"), "retained")

    def redirect(targets: DataFrame, target: Column) -> None:
        """Let owners follow their clusters."""
        nonlocal owners
        now = targets.select(F.col("cluster").alias("owner"), target.cast("int").alias("_now"))
        owners = owners.join(now, "owner", "left").select("cluster", F.coalesce("_now", "owner").alias("owner"))

    def report() -> None:
        inside = discard.agg(F.sum("n").alias("ds_points"))
        outside = compressed.agg(F.count("*").alias("cs_clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("cs_points"))
        number, left = F.lit(len(rounds) + 1).alias("round"), F.lit(n_retained).cast("bigint").alias("rs_points")
        rounds.append(inside.crossJoin(outside).select(number, "ds_points", "cs_clusters", "cs_points", left))  # one row with one

    recluster(k)
    report()
    for i in range(1, chunks):
        assigned = stage(assign(chunk(i), Summaries.collect(discard), alpha), "assigned")
        taken = assigned.where(F.col("cluster").isNotNull())
        discard = stage(added_up(discard.unionByName(cluster_summary(taken))), "summary")
        discard_members.append(taken.select("id", "cluster"))
        left = assigned.where(F.col("cluster").isNull()).select("id", "features")
        retained, n_retained = stage_counted(retained.unionByName(left), "retained")
        recluster(RETAINED_FACTOR * k)
        targets = merge_targets(compressed, alpha)
        compressed = stage(moved(compressed, targets), "summary")
        redirect(targets, F.col("into"))
        if i == chunks - 1:
            targets = stage(discard_targets(compressed, discard, alpha), "targets")
            discard = stage(added_up(discard.unionByName(moved(compressed, targets))), "summary")
            compressed = stage(compressed.join(targets, "cluster", "left_anti"), "summary")
            redirect(targets, -F.col("into") - 1)  # discard cluster d is owner -d - 1
        report()

    labels = _union(discard_members)
    if compressed_members:
        final = F.when(F.col("owner") < 0, -F.col("owner") - 1).otherwise(F.lit(-1))
        inner = _union(compressed_members).join(owners, "cluster")
        labels = labels.unionByName(inner.select("id", final.cast("int").alias("cluster")))
    labels = labels.unionByName(retained.select("id", F.lit(-1).alias("cluster")))
    return _union(rounds), labels


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
