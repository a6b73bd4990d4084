"""Approximate nearest neighbours by cosine in a forest of random-projection trees.

Every tree halves the vectors again and again: one random direction a level, one
threshold a node, the median of a bounded sample's projections there.  The forest is
the directions and thresholds only (fitted on at most ``SAMPLE`` vectors) and every
vector is put into one leaf of every tree.

A query descends all trees through one priority queue: whenever it takes a branch, the
other one is queued with the largest distance to a threshold met on its way, and the
queue deals out leaves until enough of them are found: as many as bring the sample's
own queries to ``RECALL`` against brute force over the sample.  (Vectors without any
structure need a fixed share of all leaves, clustered ones a few.)  Queries are then sent to
their leaves, where all members are compared by matrix products in double precision;
the best are ranked again by the exact measure.  A task merges a query's best over all
leaves and trees that it holds, so as many rows a query leave it whatever the number of
leaves, and what the tasks give is merged once more.  A leaf's members and its queries are both dealt to parts of about ``PART`` rows,
and each pair of parts is one group, so a crowded region is compared in many tasks and
no matrix grows with the table.

Vectors that are null or zero, hold null or non-finite components or differ in length
from the most frequent length (the longer of equals) take no part.  Of rows with the
same id and vector one counts.  Of equal vectors only the ``k + 1`` smallest ids can be
among anyone's ``k`` nearest, and only those are indexed; as queries all take part.
Fewer candidates than ``k`` give fewer rows, an empty table none.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oremill.llm.line_dedup import _groups
from oremill.plans.staging import stage

TREES = 8
RECALL = 0.96  # of the sample's queries, from which the number of visited leaves follows
PROBES = 64  # sample rows that are tried as queries
SAMPLE = 1 << 16
LEAF = 256  # rows aimed at in a leaf
SAMPLE_LEAF = 8  # sample rows that a threshold needs on each side
PART = 2048
HELD = 1 << 20  # rows of queries' best that a task holds
SEED = 7


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """Distinct ``(id, v)`` of the vectors that take part."""
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    sizes = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    return sound.join(F.broadcast(sizes.select("n")), F.size("v") == F.col("n"), "left_semi")


@dataclass
class Forest:
    """``directions[tree, level]`` and, by heap order of nodes, ``thresholds[tree]``."""

    directions: np.ndarray
    thresholds: np.ndarray

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> Forest:
        """Depth from the rows to index, but never finer than the sample can tell."""
        wanted = math.ceil(math.log2(max(rows / leaf, 1)))
        depth = max(0, min(wanted, int(math.log2(max(len(sample) / SAMPLE_LEAF, 1)))))
        width = sample.shape[1] if sample.ndim == 2 else 0
        directions = np.random.default_rng(seed).standard_normal((trees, depth, width))
        thresholds = np.zeros((trees, (1 << depth) - 1))
        for tree in range(trees):
            projected = sample @ directions[tree].T if depth else np.zeros((len(sample), 0))
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                first = (1 << level) - 1
                order = np.lexsort((projected[:, level], node))
                ends = np.searchsorted(node[order], np.arange(first, 2 * first + 2))
                for n in range(first, 2 * first + 1):
                    members = projected[order[ends[n - first] : ends[n - first + 1]], level]
                    thresholds[tree, n] = np.median(members) if len(members) else 0.0
                node = 2 * node + 1 + (projected[:, level] > thresholds[tree, node])
        return cls(directions, thresholds)

    def margins(self, unit: np.ndarray) -> np.ndarray:
        """Projections by vector, tree and level."""
        return np.einsum("nd,tld->ntl", unit, self.directions, optimize=True)

    def leaf(self, unit: np.ndarray) -> np.ndarray:
        """Leaf by vector and tree."""
        projected = self.margins(unit)
        node = np.zeros(projected.shape[:2], np.int64)
        trees = np.arange(len(self.directions))
        for level in range(self.depth):
            node = 2 * node + 1 + (projected[:, :, level] > self.thresholds[trees, node])
        return node - ((1 << self.depth) - 1)

    def search(self, projected: np.ndarray, leaves: int) -> list[tuple[int, int]]:
        """The ``(tree, leaf)`` a query visits, nearest first; ``projected`` by tree and level."""
        queue = [(0.0, tree, 0, 0) for tree in range(len(projected))]
        found = []
        while queue and len(found) < leaves:
            far, tree, node, level = heapq.heappop(queue)
            while level < self.depth:
                gap = projected[tree, level] - self.thresholds[tree, node]
                other = 2 * node + 1 + (gap <= 0)
                heapq.heappush(queue, (max(far, abs(gap)), tree, other, level + 1))
                node, level = 2 * node + 1 + (gap > 0), level + 1
            found.append((tree, node - ((1 << self.depth) - 1)))
        return found


    def leaves_for(self, unit: np.ndarray, k: int, recall: float, probes: int = PROBES) -> int:
        """Leaves to visit so that the first ``probes`` rows find ``recall`` of their ``k`` nearest rows."""
        everywhere = len(self.directions) << self.depth
        rows = min(probes, len(unit))
        near = unit[:rows] @ unit.T
        near[np.arange(rows), np.arange(rows)] = -2.0
        wanted = np.argsort(-near, axis=1, kind="stable")[:, : min(k, max(len(unit) - 1, 0))]
        if not wanted.size:
            return everywhere
        cells = self.leaf(unit)
        trees = np.arange(len(self.directions))
        found_at = []
        for projected, nearest_rows in zip(self.margins(unit[:rows]), wanted):
            turn = np.zeros((len(self.directions), 1 << self.depth), np.int64)
            for n, (tree, leaf) in enumerate(self.search(projected, everywhere), 1):
                turn[tree, leaf] = n
            found_at += [turn[trees, cells[r]].min() for r in nearest_rows]
        return int(np.sort(found_at)[min(len(found_at) - 1, math.ceil(recall * len(found_at)) - 1)])


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow column of equally long lists."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if not len(vectors):
        return np.zeros((0, 0))
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    largest = np.abs(v).max(axis=1, keepdims=True)  # tiny and huge components would lose their squares
    scaled = v / largest
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit(rows: DataFrame, k: int, trees: int, leaf: int, sample: int, recall: float, seed: int) -> tuple[Forest, int]:
    """A forest and the leaves to visit, from about ``sample`` rows of smallest hash."""
    total = rows.count()
    share = min(1.0, sample / max(total, 1))
    hashed = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 30))
    picked = rows.where(hashed <= int(share * (1 << 30))).select(hashed.alias("at"), "id", "v").collect()
    unit = _unit(np.array([r["v"] for r in sorted(picked)], np.float64)) if picked else np.zeros((0, 0))
    forest = Forest.fit(unit, total, trees, leaf, seed)
    return forest, forest.leaves_for(unit, k, recall)


def _leaves(forest: Forest, vector: Column) -> Column:
    """Array of a member's cells, one a tree."""

    @F.arrow_udf("array<bigint>")
    def cells(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        base = np.arange(len(forest.directions)) << forest.depth
        for batch in batches:
            found = forest.leaf(_unit(_matrix(batch))) + base if len(batch) else np.zeros((0, len(base)), np.int64)
            yield pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * len(base), pa.array(found.ravel(), pa.int64()))

    return cells(vector)


def _visited(forest: Forest, vector: Column, leaves: int) -> Column:
    """Array of the cells a query visits."""

    @F.arrow_udf("array<bigint>")
    def cells(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            projected = forest.margins(_unit(_matrix(batch))) if len(batch) else []
            yield pa.array([[(tree << forest.depth) + leaf for tree, leaf in forest.search(p, leaves)] for p in projected], pa.list_(pa.int64()))

    return cells(vector)


def _exact(queries: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Cosines of paired rows; each depends on its own pair only."""
    dots = (queries * members).sum(axis=1)
    return dots / (np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((members * members).sum(axis=1)))


def _compare(k: int):
    """Best ``k`` members for every query, of one part of a cell's queries and one of its members."""

    def best(group: pa.Table) -> pa.Table:
        asked = group["asks"].to_numpy()
        ids, vectors = group["id"].to_numpy(), _matrix(group["v"])
        q, m = vectors[asked], vectors[~asked]
        out: list[tuple] = []
        if len(q) and len(m):
            q_ids, m_ids = ids[asked], ids[~asked]
            near = _unit(q) @ _unit(m).T
            near[q_ids[:, None] == m_ids[None, :]] = -2.0
            top = min(k, near.shape[1])
            edge = np.partition(near, near.shape[1] - top, axis=1)[:, near.shape[1] - top]
            rows, columns = np.nonzero((near >= edge[:, None] - 1e-9) & (near > -1.5))  # ties to the last bit are settled below
            scores = _exact(q[rows], m[columns])
            order = np.lexsort((m_ids[columns], -scores, rows))
            rows, columns, scores = rows[order], columns[order], scores[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            kept = place < k
            out = [q_ids[rows[kept]], m_ids[columns[kept]], scores[kept]]
        return pa.table(out or [[], [], []], schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return best


def _merged(found: list[list[np.ndarray]], k: int) -> list[np.ndarray]:
    """The best ``k`` of every query among rows that may come from several leaves."""
    q, m, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((m, -score, q))
    q, m, score = q[order], m[order], score[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (m[1:] != m[:-1])  # equal pairs have equal scores
    q, m, score = q[new], m[new], score[new]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return [q[kept], m[kept], score[kept]]


def _best(k: int):
    """The best ``k`` rows of every query over the groups of a task, or of as many groups as fill ``HELD`` rows."""
    compare = _compare(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for group in _groups(batches, ("cell", "part", "ask_part")):
            near = compare(group)
            held.append([near[c].to_numpy() for c in ("query_id", "vec_id", "score")])
            size += near.num_rows
            if size >= 2 * HELD:
                held = [_merged(held, k)]
                size = len(held[0][0])
                if size >= HELD:
                    yield told(held[0])
                    held, size = [], 0
        if held:
            yield told(_merged(held, k))

    def told(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame,
    asks: Column,
    k: int = 5,
    id: str = "vec_id",
    vector: str = "embedding",
    trees: int = TREES,
    leaf: int = LEAF,
    sample: int = SAMPLE,
    recall: float = RECALL,
    seed: int = SEED,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of the rows for which ``asks`` (over column ``id``) holds."""
    rows = stage(usable(vectors, id, vector).distinct(), "vectors")
    same = Window.partitionBy("v").orderBy("id")
    members = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).select("id", "v")
    members = stage(members, "members")
    forest, leaves = fit(members, k, trees, leaf, sample, recall, seed)
    indexed = stage(members.withColumn("cells", _leaves(forest, F.col("v"))), "index")
    placed = indexed.select("id", "v", F.explode("cells").alias("cell"))
    asking = stage(rows.where(asks).withColumn("cells", _visited(forest, F.col("v"), leaves)), "queries")
    queries = asking.select("id", "v", F.explode("cells").alias("cell"))
    # Cells that no query visits drop out here.
    counts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    counts = counts.join(queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).alias("ask_parts")), "cell")
    counts = stage(counts, "cells")
    own = lambda parts: F.pmod(F.xxhash64("id"), F.col(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1))
    placed = placed.join(counts, "cell").withColumn("part", own("parts")).withColumn("ask_part", each("ask_parts"))
    queries = queries.join(counts, "cell").withColumn("ask_part", own("ask_parts")).withColumn("part", each("parts"))
    columns = ("cell", "part", "ask_part", "id", "v")
    met = queries.select(*columns, F.lit(True).alias("asks")).unionByName(placed.select(*columns, F.lit(False).alias("asks")))
    dealt = met.repartition("cell", "part", "ask_part").sortWithinPartitions("cell", "part", "ask_part")
    found = dealt.mapInArrow(_best(k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
