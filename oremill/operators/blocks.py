"""Tables of vertex pairs as blocks of a matrix.

Vertices are numbered component by component and fall into blocks of ``SIDE`` numbers.
A row ``(rb, cb, cells, values)`` holds the pairs between two blocks: ``cells`` are places
``row * SIDE + column`` within the block, ``values`` what stands there.  Blocks without
pairs have no row, so a table takes what its pairs take.  Spark joins and groups the
blocks; a task multiplies two of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 256
BLOCK = "rb bigint, cb bigint, cells array<int>, values array<double>"
RESULT = pa.schema([("rb", pa.int64()), ("cb", pa.int64()), ("cells", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "16m"}  # two full blocks and their values take 1.6 MB


def block(number: str | Column) -> Column:
    number = F.col(number) if isinstance(number, str) else number
    return F.floor(number / F.lit(SIDE))


def place(number: str) -> Column:
    return F.pmod(F.col(number), F.lit(SIDE)).cast("int")


def _dense(cells: np.ndarray, values: np.ndarray | float) -> np.ndarray:
    out = np.zeros(SIDE * SIDE)
    out[cells] = values
    return out.reshape(SIDE, SIDE)


def _lists(column: pa.ListArray) -> list[np.ndarray | None]:
    return [None if x.values is None else x.values.to_numpy(zero_copy_only=False) for x in column]


def _operands(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[_lists(batch.column(n)) for n in names])


def _one_block(key: tuple, cells: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    arrays = [
        pa.array([key[0].as_py()], pa.int64()),
        pa.array([key[1].as_py()], pa.int64()),
        pa.array([cells.astype(np.int32)], pa.list_(pa.int32())),
        pa.array([values], pa.list_(pa.float64())),
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=RESULT)


def _product(total: np.ndarray, cells: np.ndarray, values: np.ndarray, edges: np.ndarray) -> None:
    """Adds a block times a block of edges, over the columns of one that are rows of the other."""
    inner = np.intersect1d(cells % SIDE, edges // SIDE)
    total += _dense(cells, values)[:, inner] @ _dense(edges, 1.0)[inner]


def new_cells(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path counts that reach a block, without the cells of earlier levels (rows that have no edges)."""
    total, old = np.zeros((SIDE, SIDE)), np.zeros(SIDE * SIDE, dtype=bool)
    for cells, values, edges in _operands(batches, ("cells", "values", "edges")):
        if edges is None:
            old[cells] = True
        else:
            _product(total, cells, values, edges)
    flat = total.reshape(-1)
    found = np.flatnonzero((flat > 0) & ~old)
    if len(found):
        yield _one_block(key, found, flat[found])


def units(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each cell of a level (the row that has no edges) passes on per path: ``1 / sigma`` and its children's units."""
    total, level = np.zeros((SIDE, SIDE)), None
    for cells, values, edges in _operands(batches, ("cells", "values", "edges")):
        if edges is None:
            level = cells, values
        else:
            _product(total, cells, values, edges)
    if level is not None:
        cells, sigma = level
        yield _one_block(key, cells, 1 / sigma + total.reshape(-1)[cells])


def edge_flows(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flow along the edges (the row without ``below``) from a block of parents to one of children, over all roots."""
    total, edges = np.zeros((SIDE, SIDE)), None
    for cells, values, below, passed in _operands(batches, ("cells", "values", "below", "passed")):
        if below is None:
            edges = cells
        else:
            roots = np.intersect1d(cells // SIDE, below // SIDE)
            total += _dense(cells, values)[roots].T @ _dense(below, passed)[roots]
    if edges is not None:
        flow = total.reshape(-1)[edges]
        if flow.any():
            yield _one_block(key, edges[flow > 0], flow[flow > 0])
