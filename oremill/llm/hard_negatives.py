"""Hard negatives by Fagin's threshold algorithm over blocks of vectors.

Vectors become integer vectors floor(256 x).  The score of a row for an anchor is their
inner product; higher scores come first, ties by smaller id.  An anchor's positives are
its first rows of the same label; the negatives of a positive are the first rows of other
labels whose score lies in a window below the positive's score.

Both searches run in blocks of ``BLOCK`` rows.  A block holds, for every dimension, its
rows sorted by value.  An anchor reads these lists from the end that its sign in the
dimension makes the best, deeper at each step; rows met for the first time are scored at
random access.  No row further down any list can score more than the threshold, the sum of
the anchor's products with the values the lists have come to; once it is strictly below
the k-th score of every search (or the window's lower edge while fewer are found), the
block is done.  Strictly, because a row at the same score may have a smaller id.

Every anchor meets every row once in each search: rows are dealt by a hash to
``ROW_PARTS`` parts and anchors to as many as keep ``PART_ANCHORS`` in one.  A task
takes one pair of parts, goes through the rows block by block and keeps a running top
for each search, so at most ``row_parts`` tops of each search are shuffled.  On large
clusters raise ``row_parts`` to the number of tasks wanted at once.

Odd rows: rows with a null id, label or vector, or with a null or non-finite component,
take no part, and neither do rows whose vector is longer or shorter than the most common
length of the table (the smaller of equally common ones).  Of rows with one id the least by
label and vector counts, the others take no part.  Vectors of zeros take part.  An empty
table, or one without anchors, gives no rows; an anchor without others of its label, or a
positive without rows in its window, neither.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oremill.plans.staging import stage

POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of its positive's score.
LOW, HIGH = 30, 90
SCALE = 256
BLOCK = 8192
ROW_PARTS = 16
PART_ANCHORS = 16_384
FIRST_STEP = 32

RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(table: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """``(id, label, v)``: one row an id, integer vectors of one length."""
    as_doubles = F.col(vector).cast("array<double>")
    rows = table.select(F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"), as_doubles.alias("x"))
    finite = ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    lengths = rows.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("rows"))
    common = lengths.orderBy(F.desc("rows"), "length").limit(1).select("length")
    rows = rows.join(F.broadcast(common), F.size("x") == F.col("length"), "left_semi")  # one row
    whole_numbers = F.transform("x", lambda x: F.floor(x * SCALE).cast("bigint"))
    one = rows.select("id", F.struct("label", whole_numbers.alias("v")).alias("r")).groupBy("id").agg(F.min("r").alias("r"))
    return one.select("id", "r.label", "r.v")


class Block:
    """Rows with their lists: for each dimension the rows from the least to the greatest value."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.lists = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(vectors, self.lists.T, axis=0).T.copy()

    def search(self, anchor: np.ndarray, done: Callable[[float], bool], take: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Hands new rows and their scores to ``take``, until ``done`` says so of the threshold."""
        rows = len(self.ids)
        used = np.flatnonzero(anchor)
        backwards = anchor[used] > 0
        seen = np.zeros(rows, bool)
        depth, step = 0, FIRST_STEP
        if not len(used):  # all scores are 0
            take(np.arange(rows), np.zeros(rows, np.int64))
            return
        while depth < rows:
            upto = min(rows, depth + step)
            met = np.zeros(rows, bool)
            met[self.lists[used[backwards], rows - upto : rows - depth]] = True
            met[self.lists[used[~backwards], depth:upto]] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            if len(new):
                take(new, self.vectors[new] @ anchor)
            if seen.all():
                return
            edge = np.where(backwards, self.values[used, rows - upto], self.values[used, upto - 1])
            if done(int(edge @ anchor[used])):
                return
            depth, step = upto, 2 * step


class Tops:
    """The best ``k`` rows of each of several searches of one anchor, with their lower and upper edges."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray):
        self.k, self.low, self.high = k, low, high
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for i, (had_ids, had_scores) in enumerate(self.best):
            least = max(self.low[i], had_scores[-1]) if len(had_ids) == self.k else self.low[i]
            fits = (scores >= least) & (scores <= self.high[i])
            if fits.any():
                all_ids, all_scores = np.append(had_ids, ids[fits]), np.append(had_scores, scores[fits])
                order = np.lexsort((all_ids, -all_scores))[: self.k]
                self.best[i] = all_ids[order], all_scores[order]

    def closed(self, threshold: int) -> bool:
        return all(threshold < (scores[-1] if len(ids) == self.k else low) for (ids, scores), low in zip(self.best, self.low))


EDGE = 1 << 62


def _search(same_label: bool, k: int, block: int):
    """Runs the searches of the anchors of each pair of parts over its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in groupby(_pieces(batches, block), itemgetter(0)):
            anchors: list[tuple] = []
            held: list[pa.RecordBatch] = []
            rows = 0
            for _, kind, piece in pieces:
                if kind == 0:  # anchors come first
                    anchors += _anchors(piece, k, same_label)
                    continue
                held.append(piece)
                rows += piece.num_rows
                if rows >= block:
                    _meet(anchors, held, same_label)
                    held, rows = [], 0
            if held:
                _meet(anchors, held, same_label)
            yield from _told(anchors)

    return run


def _pieces(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
    """Sorted batches cut where the pair of parts or the kind of row changes, and at ``block`` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        by = np.stack([batch.column(c).to_numpy() for c in ("part", "asked", "kind")])
        cuts = [0, *(np.flatnonzero((by[:, 1:] != by[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            for at in range(start, end, block):
                yield (int(by[0, start]), int(by[1, start])), int(by[2, start]), batch.slice(at, min(block, end - at))


def _matrix(piece: pa.RecordBatch) -> np.ndarray:
    flat = piece.column("v").flatten().to_numpy()
    return flat.reshape(piece.num_rows, -1)


def _anchors(piece: pa.RecordBatch, k: int, same_label: bool) -> list[tuple]:
    """Per anchor its id, label, vector and searches."""
    vectors, out = _matrix(piece), []
    for i, (anchor, label, edges) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("id", "label", "edges")))):
        if same_label:
            low, high = [-EDGE], [EDGE]
        else:
            low, high = [e["low"] for e in edges], [e["high"] for e in edges]
        out.append((anchor, label, vectors[i], Tops(k, np.array(low, np.int64), np.array(high, np.int64))))
    return out


def _meet(anchors: list[tuple], held: list[pa.RecordBatch], same_label: bool) -> None:
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    block = Block(rows.column("id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows))
    for anchor, label, vector, tops in anchors:

        def take(new: np.ndarray, scores: np.ndarray) -> None:
            fits = (block.labels[new] == label) & (block.ids[new] != anchor) if same_label else block.labels[new] != label
            tops.add(block.ids[new][fits], scores[fits])

        block.search(vector, tops.closed, take)


def _told(anchors: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(anchors), 1024):
        rows = [
            (anchor, place, int(row), int(score))
            for anchor, _, _, tops in anchors[at : at + 1024]
            for place, best in enumerate(tops.best)
            for row, score in zip(*best)
        ]
        if rows:
            names = ["anchor", "search", "row", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names)


def _best(anchors: DataFrame, rows: DataFrame, same_label: bool, k: int, row_parts: int, anchor_parts: int, block: int) -> DataFrame:
    """``(anchor, search, rank, row, score)``: the best ``k`` rows of every search of every anchor."""
    nothing = F.lit(None).cast("array<struct<low: bigint, high: bigint>>")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = anchors.withColumn("asked", F.pmod(F.xxhash64("id"), F.lit(anchor_parts)).cast("int")).select(
        every(row_parts).alias("part"), "asked", F.lit(0).alias("kind"), "id", "label", "v", "edges"
    )
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(row_parts)).cast("int")).select(
        "part", every(anchor_parts).alias("asked"), F.lit(1).alias("kind"), "id", "label", "v", nothing.alias("edges")
    )
    met = asked.unionByName(dealt).repartition("part", "asked").sortWithinPartitions("part", "asked", "kind")
    tops = met.mapInArrow(_search(same_label, k, block), "anchor bigint, search int, row bigint, score bigint")
    order = Window.partitionBy("anchor", "search").orderBy(F.desc("score"), "row")
    return tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(
    table: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
    row_parts: int = ROW_PARTS,
    part_anchors: int = PART_ANCHORS,
    block: int = BLOCK,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchors`` is a condition on ``id``; ``label`` an expression over the table's columns.
    """
    rows = stage(usable(table, key, vector, F.col("label") if label is None else label), "vectors")
    asked = rows.where(anchors)
    anchor_parts = max(1, -(-asked.count() // part_anchors))
    unset = F.lit(None).cast("array<struct<low: bigint, high: bigint>>").alias("edges")
    positives = stage(_best(asked.select("*", unset), rows, True, POSITIVES, row_parts, anchor_parts, block), "positives")
    # LOW * p <= 100 * n <= HIGH * p in whole numbers.
    score = F.col("score")
    edges = F.struct((-F.expr(f"floor(-{LOW} * cast(score as decimal(38, 0)) / 100)")).cast("bigint").alias("low"), F.expr(f"floor({HIGH} * cast(score as decimal(38, 0)) / 100)").cast("bigint").alias("high"))
    windows = positives.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", edges.alias("e")))), lambda x: x["e"]).alias("edges"))
    searching = asked.join(windows, F.col("id") == F.col("anchor")).select("id", "label", "v", "edges")
    negatives = _best(searching, rows, False, NEGATIVES, row_parts, anchor_parts, block)
    known = positives.select(
        F.col("anchor").alias("anchor_id"), (F.col("rank") - 1).alias("search"), F.col("row").alias("positive_id"), score.alias("positive_score")
    )
    found = negatives.select(F.col("anchor").alias("anchor_id"), "search", "rank", F.col("row").alias("negative_id"), score.alias("negative_score"))
    return known.join(found, ["anchor_id", "search"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
