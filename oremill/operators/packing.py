"""Pairs of vertices in packed rows: overlaps of baskets, neighbour lists, spanning forests.

Spark moves and groups the rows; numpy takes one bounded slice of them at a time.  A message
says that the vertex ``src`` meets each vertex of a run of larger ones.  The messages of many
lists to one part are columns of gaps, stored plane by plane (all lowest bytes first), so
that a vertex that is met takes a byte or two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_PAIRS = 1 << 21  # pairs that a worker spells out at once
HELD_PAIRS = 1 << 22  # pairs that a worker holds before it sums equal ones
ROW_ENDS = 1 << 16  # vertices in one row of neighbours
MESSAGES = "part bigint, srcs binary, lengths binary, gaps binary"
MESSAGES_ARROW = pa.schema([("part", pa.int64()), *[(c, pa.binary()) for c in ("srcs", "lengths", "gaps")]])
COUNTED = "src bigint, others array<bigint>, shared array<bigint>"
COUNTED_ARROW = pa.schema([("src", pa.int64()), ("others", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64()))])

Batches = Iterator[pa.RecordBatch]


def _planes(values: np.ndarray) -> bytes:
    """Integers as planes of bytes, as many as the largest takes; negative ones take all eight."""
    values = np.ascontiguousarray(values, dtype="<i8")
    size = 8 if values.min() < 0 else max(1, -(-int(values.max()).bit_length() // 8))
    return bytes([size]) + values.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    size = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.view("<i8").reshape(-1)


def _mixed(values: np.ndarray) -> np.ndarray:
    """Well mixed unsigned hashes of integers."""
    mixed = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def _runs(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``first, first + 1, ...`` of every run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + lengths, lengths)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column."""
    changed = np.ones(len(columns[0]), bool)
    changed[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(changed)


def _blobs(parts: np.ndarray, srcs: np.ndarray, lengths: np.ndarray, gaps: np.ndarray) -> pa.RecordBatch:
    """A row a part from messages in order of parts."""
    begin = _starts(parts)
    end = np.append(begin[1:], len(parts))
    reach = np.append(0, np.cumsum(lengths))
    columns = [[], [], []]
    for a, b in zip(begin, end):
        for column, values in zip(columns, (np.diff(srcs[a:b], prepend=0), lengths[a:b], gaps[reach[a] : reach[b]])):
            column.append(_planes(values))
    return pa.RecordBatch.from_arrays([pa.array(parts[begin]), *[pa.array(c, pa.binary()) for c in columns]], schema=MESSAGES_ARROW)


def _sliced(batches: Batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Keys, lengths of lists, and places a key is dealt to, of slices of lists with about ``SLICE_PAIRS`` pairs."""
    for batch in batches:
        column = batch.column("keys")
        offsets = column.offsets.to_numpy().astype(np.int64)
        lengths = np.diff(offsets)
        pairs = np.cumsum(lengths * (lengths - 1) // 2)
        at = 0
        while at < len(lengths):
            done = pairs[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(pairs, done + SLICE_PAIRS, "right")))
            inside = slice(offsets[at], offsets[to])
            salts = batch.column("salts").values.to_numpy()[inside] if "salts" in batch.schema.names else None
            yield column.values.to_numpy()[inside], lengths[at:to], salts
            at = to


def messages(parts: int) -> Callable[[Batches], Batches]:
    """From sorted lists ``keys`` (with ``salts``, the places of a key, where some have many): every key and those after it, by part."""

    def run(batches: Batches) -> Batches:
        for keys, lengths, salts in _sliced(batches):
            ends = np.repeat(np.cumsum(lengths), lengths)
            places = np.arange(len(keys))
            after = ends - places - 1
            gap = np.diff(keys, prepend=0)
            spread = salts > 1 if salts is not None else np.zeros(len(keys), bool)
            at = places[(after > 0) & ~spread]
            if len(at):
                part = (_mixed(keys[at]) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((keys[at], part))
                at, part = at[order], part[order]
                yield _blobs(part, keys[at], after[at], gap[_runs(at + 1, after[at])])
            at = places[(after > 0) & spread]
            if len(at):
                others = keys[_runs(at + 1, after[at])]
                at = np.repeat(at, after[at])
                salt = _mixed(others) % salts[at].astype(np.uint64)
                part = ((_mixed(keys[at]) + salt) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((others, at, part))
                at, part, others = at[order], part[order], others[order]
                begin = _starts(part, at)
                yield _sent(part[begin], keys[at[begin]], begin, np.diff(np.append(begin, len(at))), others)

    return run


def _sent(parts: np.ndarray, srcs: np.ndarray, first: np.ndarray, lengths: np.ndarray, others: np.ndarray) -> pa.RecordBatch:
    """``_blobs`` of messages in any order; ``others`` from ``first`` on are what a source meets."""
    order = np.lexsort((srcs, parts))
    parts, srcs, lengths = parts[order], srcs[order], lengths[order]
    met = others[_runs(first[order], lengths)]
    gaps = np.diff(met, prepend=0)
    begin = np.cumsum(lengths) - lengths
    gaps[begin] = met[begin] - srcs
    return _blobs(parts, srcs, lengths, gaps)


def both_ways(parts: int) -> Callable[[Batches], Batches]:
    """From ``(src, others)``, every pair once: messages of every vertex to the part that gets all its neighbours."""

    def run(batches: Batches) -> Batches:
        for src, lengths, others in _cut(batches):
            for heads, first, sizes, ends in (
                (src, np.cumsum(lengths) - lengths, lengths, others),
                _turned(np.repeat(src, lengths), others),
            ):
                yield _sent((_mixed(heads) % np.uint64(parts)).astype(np.int64), heads, first, sizes, ends)

    return run


def _cut(batches: Batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sources, numbers of their neighbours, and these, of slices of about ``SLICE_PAIRS`` neighbours."""
    for batch in batches:
        column = batch.column("others")
        offsets = column.offsets.to_numpy().astype(np.int64)
        src, values, at = batch.column("src").to_numpy(), column.values.to_numpy(), 0
        while at < len(src):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_PAIRS, "right")) - 1)
            if offsets[to] > offsets[at]:
                lengths = np.diff(offsets[at : to + 1])
                yield src[at:to][lengths > 0], lengths[lengths > 0], values[offsets[at] : offsets[to]]
            at = to


def _turned(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ends of the pairs, each with the sources that meet it: heads, where theirs begin, how many, and these."""
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    begin = _starts(dst)
    return dst[begin], begin, np.diff(np.append(begin, len(dst))), src


def _met(srcs: bytes, lengths: bytes, gaps: bytes) -> tuple[np.ndarray, np.ndarray]:
    srcs, lengths, gaps = np.cumsum(_unplaned(srcs)), _unplaned(lengths), np.cumsum(_unplaned(gaps))
    begin = np.cumsum(lengths) - lengths
    before = np.where(begin > 0, gaps[begin - 1], 0)
    return np.repeat(srcs, lengths), gaps + np.repeat(srcs - before, lengths)


def _summed(src: np.ndarray, dst: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each occurs."""
    low, first = int(src.min()), int(dst.min())
    width = int(dst.max()) - first + 1
    if (int(src.max()) - low + 1) * width < 2**63:
        codes = (src - low) * width + (dst - first)
        if counts is None:
            codes.sort()
        else:
            order = np.argsort(codes)
            codes, counts = codes[order], counts[order]
        begin = _starts(codes)
        src, dst = np.divmod(codes[begin], width)
        src, dst = src + low, dst + first
    else:
        order = np.lexsort((dst, src))
        src, dst, counts = src[order], dst[order], None if counts is None else counts[order]
        begin = _starts(src, dst)
        src, dst, size = src[begin], dst[begin], len(src)
        return src, dst, np.diff(np.append(begin, size)) if counts is None else np.add.reduceat(counts, begin)
    return src, dst, np.diff(np.append(begin, len(codes))) if counts is None else np.add.reduceat(counts, begin)


def _rows(src: np.ndarray) -> np.ndarray:
    """Where the rows of neighbours begin and end: one source a row, ``ROW_ENDS`` neighbours at most."""
    begin = _starts(src)
    return np.unique(np.concatenate([begin, [len(src)], *[np.arange(a, b, ROW_ENDS) for a, b in zip(begin, [*begin[1:], len(src)]) if b - a > ROW_ENDS]]))


def _listed(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def counted(least: int) -> Callable[[tuple, Batches], Batches]:
    """From the messages to a part: the vertices that each one meets ``least`` times or more, and how often."""

    def run(key: tuple, batches: Batches) -> Batches:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        pairs, size = None, 0

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            new = _summed(*[np.concatenate(x) for x in zip(*held)], None)
            return new if pairs is None else _summed(*[np.concatenate(x) for x in zip(pairs, new)])

        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("srcs", "lengths", "gaps")]):
                held.append(_met(*[x.as_py() for x in row]))
                size += len(held[-1][0])
                if size >= HELD_PAIRS:
                    pairs, size = summed(), 0
                    held.clear()
        src, dst, shared = summed() if held else pairs
        kept = shared >= least
        if kept.any():
            src, dst, shared = src[kept], dst[kept], shared[kept]
            at = _rows(src)
            yield pa.RecordBatch.from_arrays([pa.array(src[at[:-1]]), _listed(at, dst), _listed(at, shared)], schema=COUNTED_ARROW)

    return run


def neighbours(key: tuple, batches: Batches) -> Batches:
    """From the messages to a part: ``(src, others)``, a row or a few a source."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def rows() -> pa.RecordBatch:
        src, dst, _ = _summed(*[np.concatenate(x) for x in zip(*held)], None)
        held.clear()
        at = _rows(src)
        return pa.RecordBatch.from_arrays([pa.array(src[at[:-1]]), _listed(at, dst)], names=["src", "others"])

    for batch in batches:
        for row in zip(*[batch.column(c) for c in ("srcs", "lengths", "gaps")]):
            held.append(_met(*[x.as_py() for x in row]))
            if sum(len(src) for src, _ in held) >= HELD_PAIRS:
                yield rows()
    if held:
        yield rows()


def _gathered(batches: Batches, size: int, lists: str | None = None) -> Iterator[pa.Table]:
    """The batches in tables of about ``size`` rows, or of entries in the column ``lists``."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows if lists is None else len(batch.column(lists).values)
        if rows >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def neighbour_rows(batches: Batches) -> Batches:
    """From ``(src, dst)``, those of a source after each other: ``(src, others)``, a row or a few a source."""
    for table in _gathered(batches, HELD_PAIRS // 8):
        if not table.num_rows:
            continue
        src, dst = _whole(table["src"]), _whole(table["dst"])
        names = src.dictionary_encode()
        at = _rows(names.indices.to_numpy())
        others = pa.ListArray.from_arrays(pa.array(at, pa.int32()), dst)
        yield pa.RecordBatch.from_arrays([src.take(pa.array(at[:-1])), others], names=["src", "others"])


def _least(size: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least vertex of the component of each of the vertices ``0 ... size - 1``."""
    label = np.arange(size)
    while len(src):
        a, b = label[src], label[dst]
        apart = a != b
        src, dst, a, b = src[apart], dst[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    return label


def forest(batches: Batches) -> Batches:
    """From ``(src, others)``: ``(src, dst)`` that link the same vertices, fewer than there are vertices in the task."""
    high = low = None

    for table in _gathered(batches, HELD_PAIRS // 4, "others"):
        src, lists = _whole(table["src"]), _whole(table["others"])
        if high is None:
            high = low = src.slice(0, 0)
        lengths = np.diff(lists.offsets.to_numpy())
        ends = pa.concat_arrays([src, high, lists.flatten(), low]).dictionary_encode()
        codes, names, size = ends.indices.to_numpy(), ends.dictionary, len(src) + len(high)
        from_ = np.concatenate([np.repeat(codes[: len(src)], lengths), codes[len(src) : size]])
        label = _least(len(names), from_, codes[size:])
        linked = np.flatnonzero(label != np.arange(len(names)))
        high, low = names.take(pa.array(linked)), names.take(pa.array(label[linked]))
    if high is not None:
        yield from pa.Table.from_arrays([high, low], names=["src", "dst"]).to_batches(max_chunksize=ROW_ENDS)
