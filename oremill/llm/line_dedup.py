"""Removal of repeated lines by an exact set-similarity join.

A line is the set of its words, each told by a 64-bit hash.  It is removed when an
earlier line, in the order of document id and line number, has the same set or a Jaccard
similarity of at least ``similarity``, whether or not that one is removed itself; which
lines go therefore depends on neither partitioning nor order of work.

Words are ordered by rarity: by the count of their hash cell over the whole table
(``2 ** CELL_BITS`` counts, whatever the corpus), then by hash.  Any fixed order gives
the exact result; rarity keeps the groups below short.  Two similar sets share a word among
their first ``|x| - ceil(t |x|) + 1``, so each line is listed under its prefix words, but
for those that occur once in the table.  Lines listed under one word are candidates if
their sizes allow the similarity (length filter), the words left behind their places in
the prefixes suffice (positional filter) and their 128-bit parity signatures differ in no
more bits than the sets may differ in words.
The listed rows travel as bytes, packed by buckets of words, in two rounds.

One earlier match is enough for a line to go.  So each line is first verified against its
likeliest earlier candidate alone: the candidate's words go to the lines that name it, in
groups of bounded size.  Lines that fail there and have further candidates (``open``) go
through all of these, in blocks: only words that an open line lists are listed again.
Words travel as the text of the line, fetched by one more scan of the table.

Lines without a word are kept and match nothing.  Rows with the same id count as one
document: a line number kept for one is kept for all, and the rows of null ids are one
such document, the first of all.  Null texts have no lines.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oremill.llm.ngram_join import _linked
from oremill.llm.repeats import Words, word_hashes
from oremill.llm.text import WORD, batches_of, shuffles_dropped, tidy, whole
from oremill.operators.numbering import row_numbers
from oremill.plans.staging import stage, stage_counted, unstage

SIMILARITY = 0.8
#: Cells of the word counts: 16 MB on the driver and in every task.
CELL_BITS = 24
#: Bits of the filters for lines to fetch and words to list again: 16 MB as well.
FILTER_BITS = 27
BLOCK_BITS = 16
#: Lines that one group under a word holds; longer lists are dealt to blocks.
LIST_ROWS = 4096
#: Lines verified against one copy of their candidate.
HUB_ROWS = 4096
BLOCK_ROWS = 1024
BLOCK_WORDS = 1 << 20
#: Text that a task takes up at once; the places of its words take ten times that.
BATCH_BYTES = "2m"
#: Words that a task takes up at once (arrays that stay in the cache); a line's number among them fits 20 bits.
SLICE_WORDS = 1 << 15
#: Words whose cells a task holds before it gives back their counts.
HELD_WORDS = 1 << 21
#: Listed rows that a task compares at once, buckets whole.
PIECE_ROWS = 1 << 17
#: Listed rows of a bucket, about.
BUCKET_ROWS = 1 << 18
#: Listed rows that a task holds, about, before it packs them by buckets: batches of some 4 MB.
PACKED_ROWS = 1 << 16
#: Buckets are listed and compared in so many rounds, which bounds the space they take.
ROUNDS = 2
#: Columns of listed rows and their types in a bucket's bytes; of the lines' numbers the low half.
LISTED = {"group": np.uint32, "before": np.int32, "n": np.uint32, "signature": np.int64, "second": np.int64, "size": np.int32, "place": np.int32}

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(27))


class Lines:
    """The lines with words of Arrow strings that end with a blank."""

    def __init__(self, texts: pa.Array):
        self.words = words = Words(texts)
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts)].astype(np.int64)
        breaks = np.flatnonzero(words.data == 0x0A)
        before = np.searchsorted(breaks, words.start)
        unit = before + words.text  # differs from line to line, also where one text ends
        new = np.ones(len(unit), bool)
        new[1:] = unit[1:] != unit[:-1]
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(unit))[: len(self.first)]  # one past the last word
        self.text = words.text[self.first]
        text_starts = ends - ends[0] if len(ends) else ends
        self.number = before[self.first] - np.searchsorted(breaks, text_starts)[self.text]

    def slices(self, chosen: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of lines of ``SLICE_WORDS`` words at most, one line at least: the lines, their words' hashes and lines of the slice."""
        chosen = np.arange(len(self.first)) if chosen is None else chosen
        at = 0
        while at < len(chosen):
            upto = max(at + 1, int(np.searchsorted(self.last[chosen], self.first[chosen[at]] + SLICE_WORDS, side="right")))
            mine = chosen[at:upto]
            at = upto
            low, high = int(self.first[mine[0]]), int(self.last[mine[-1]])
            hashes = _mix(word_hashes(self.words, low, high))
            lengths = self.last[mine] - self.first[mine]
            if lengths.sum() < high - low:
                hashes = hashes[np.repeat(self.first[mine] - low - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
            yield mine, hashes, np.repeat(np.arange(len(mine)), lengths)

    def string(self, lines: np.ndarray) -> pa.Array:
        """The lines' texts, from the first word to the blank behind the last."""
        start, end = self.words.start[self.first[lines]], self.words.end[self.last[lines] - 1] + 1
        data = self.words.data.tobytes()
        return pa.array([data[a:b] for a, b in zip(start.tolist(), end.tolist())], pa.binary()).cast(pa.string())


def _distinct(hashes: np.ndarray, owner: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines, hashes and codes of the distinct words of each line, the rarest first."""
    code = np.zeros(len(hashes), U) if codes is None else codes[(hashes & U((1 << CELL_BITS) - 1)).astype(np.int64)].astype(U)
    token = (owner.astype(U) << U(44)) | (code << U(36)) | (hashes >> U(28))
    order = np.argsort(token)
    sorted_token, word = token[order], hashes[order]
    if ((sorted_token[1:] == sorted_token[:-1]) & (word[1:] != word[:-1])).any():  # words of one token in one line
        order = np.lexsort((hashes, token))
        sorted_token, word = token[order], hashes[order]
    new = np.ones(len(word), bool)
    new[1:] = (sorted_token[1:] != sorted_token[:-1]) | (word[1:] != word[:-1])
    order = order[new]
    return owner[order], hashes[order], code[order]


def _summed(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, and both halves of the signatures, of sets that start at ``first``: a word flips one bit of 128."""
    key = np.add.reduceat(_mix(hashes + U(0x9E3779B97F4A7C15)), first)
    bit, half = U(1) << (hashes & U(63)), (hashes >> U(6)) & U(1)
    return key, np.bitwise_xor.reduceat(bit * (U(1) - half), first), np.bitwise_xor.reduceat(bit * half, first)


def _code(count: np.ndarray) -> np.ndarray:
    """Counts in a byte: as they are below 128, by steps of an eighth of a doubling above."""
    coded = np.minimum(count, 128).astype(np.uint8)
    large = count > 128
    coded[large] = np.minimum(128 + np.floor(8 * (np.log2(count[large]) - 7)), 255)
    return coded


def _blocked(cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Distinct sorted cells as rows of a block each: the cells' low digits, and 16-bit counts."""
    blocks, starts = np.unique(cells >> BLOCK_BITS, return_index=True)
    low = np.split((cells & ((1 << BLOCK_BITS) - 1)).astype(np.uint16), starts[1:])
    most = np.split(np.minimum(counts, 0xFFFF).astype(np.uint16), starts[1:])
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks, pa.int32()), pa.array([a.tobytes() for a in low], pa.binary()), pa.array([a.tobytes() for a in most], pa.binary())],
        ["block", "cells", "counts"],
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: the sums of its cells' counts, coded in bytes; rows come sorted by block."""
    held, total = None, np.zeros(1 << BLOCK_BITS, np.int64)

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([_code(total).tobytes()], pa.binary())], ["block", "codes"])

    for batch in batches:
        for block, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if block != held:
                if held is not None:
                    yield told()
                held, total = block, np.zeros(1 << BLOCK_BITS, np.int64)
            total[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint16)
    if held is not None:
        yield told()


def _gathered(rows: DataFrame, bits: int) -> np.ndarray:
    """Codes of all cells, from ``(block, cells, counts)``."""
    sums = rows.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(_added), "block int, codes binary")
    codes = np.zeros(1 << bits, np.uint8)
    for row in sums.collect():
        at = row["block"] << BLOCK_BITS
        codes[at : at + (1 << BLOCK_BITS)] = np.frombuffer(row["codes"], np.uint8)
    return codes


def _bits(df: DataFrame, cells_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """A packed filter of ``2 ** FILTER_BITS`` bits, set for the cells of all rows."""
    width = 1 << (BLOCK_BITS - 3)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)]
        for batch in batches:
            held.append(cells_of(batch))
            if sum(map(len, held)) >= HELD_WORDS:
                yield told(held)
                held = held[:1]
        if len(held) > 1:
            yield told(held)

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        full = np.unique(np.concatenate(held))
        return _blocked(full, np.ones(len(full), np.int64)).select(["block", "cells"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("block",)):
            seen = np.zeros(1 << BLOCK_BITS, bool)
            for cells in group["cells"].to_pylist():
                seen[np.frombuffer(cells, np.uint16)] = True
            bits = np.packbits(seen, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(group["block"][:1].to_pylist(), pa.int32()), pa.array([bits], pa.binary())], ["block", "bits"])

    rows = df.mapInArrow(tidy(cells), "block int, cells binary").repartition("block").sortWithinPartitions("block")
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in rows.mapInArrow(tidy(packed), "block int, bits binary").collect():
        bits[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    mixed = np.zeros(len(parts[0]), U)
    for part in parts:
        mixed = _mix(mixed + part.astype(np.int64).view(U) + U(0x9E3779B97F4A7C15))
    return mixed


def _cell(*parts: np.ndarray) -> np.ndarray:
    return (_mixed(*parts) & U((1 << FILTER_BITS) - 1)).astype(np.int64)


def counted(texts: DataFrame, id_type: str) -> tuple[DataFrame, np.ndarray]:
    """``(id, n_lines)`` of every row with a line, and how often each cell's words occur, coded.

    A task gives back its counts in pieces of ``HELD_WORDS``, so nothing grows with it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, kind = 0, None
        for batch in batches:
            kind = batch.schema.field("id").type
            lines = Lines(batch.column("text"))
            for _, hashes, _ in lines.slices():
                held.append((hashes & U((1 << CELL_BITS) - 1)).astype(np.int32))
                size += len(hashes)
                if size >= HELD_WORDS:
                    yield told(np.concatenate(held), kind)
                    held, size = [], 0
            n = np.bincount(lines.text, minlength=batch.num_rows)
            full = pa.array(np.flatnonzero(n))
            none = pa.nulls(len(full), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(full), pa.array(n[n > 0], pa.int64()), pa.nulls(len(full), pa.int32()), none, none],
                ["id", "n_lines", "block", "cells", "counts"],
            )
        if held:
            yield told(np.concatenate(held), kind)

    def told(cells: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        blocked = _blocked(*np.unique(cells, return_counts=True))
        n = blocked.num_rows
        return pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), *blocked.columns], ["id", "n_lines", "block", "cells", "counts"])

    both = stage(texts.mapInArrow(tidy(count), f"id {id_type}, n_lines bigint, block int, cells binary, counts binary"), "counted")
    codes = _gathered(both.where(F.col("block").isNotNull()).select("block", "cells", "counts"), CELL_BITS)
    return both.where(F.col("n_lines").isNotNull()).select("id", "n_lines"), codes


def _prefix(sizes: np.ndarray, similarity: float) -> np.ndarray:
    return sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(values))


def _line_rows(ids: pa.Array, texts: pa.Array, codes: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows of all lines with words, one for equal ones of a slice: place, size, key, signature, prefix words and the common ones among these.

    A prefix word is 32 bits of its hash, 0 if it occurs once in the table.
    """
    often = _code(np.array([LIST_ROWS]))[0]
    lines = Lines(texts)
    for mine, hashes, owner in lines.slices():
        owner, word, code = _distinct(hashes, owner, codes)
        sizes = np.bincount(owner, minlength=len(mine))
        first = np.cumsum(sizes) - sizes
        key, signature, second = _summed(word, first)
        lengths = _prefix(sizes, similarity)
        chosen = np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        short = np.maximum((word[chosen] >> U(28)) & U(0xFFFFFFFF), U(1)).astype(np.uint32).view(np.int32)
        short = np.where(code[chosen] > 1, short, 0).astype(np.int32)
        common = code[chosen] >= often
        of = np.repeat(np.arange(len(mine)), lengths)
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(lines.text[mine])),
                pa.array(lines.number[mine], pa.int32()),
                pa.array(sizes, pa.int32()),
                pa.array(key.view(np.int64)),
                pa.array(signature.view(np.int64)),
                pa.array(second.view(np.int64)),
                _lists(short, lengths),
                _lists(short[common], np.bincount(of[common], minlength=len(mine))),
            ],
            ["id", "line", "size", "key", "signature", "second", "prefix", "often"],
        )


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of the rows with equal ``by``, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(c).to_numpy() for c in by])
        cuts = [0, *(np.nonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(ids[:, start].tolist())
            if held and key != held_key:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held_key = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _possible(size_a, place_a, size_b, place_b, apart, similarity: float) -> np.ndarray:
    """Length, positional and signature filters for sets whose signatures are ``apart`` bits apart."""
    least = np.ceil(similarity / (1 + similarity) * (size_a + size_b) - 1e-9)  # words that must be shared
    fits = (np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b) - 1e-9)
    fits &= np.minimum(size_a - place_a, size_b - place_b) >= least - np.minimum(place_a, place_b)
    return fits & (apart <= size_a + size_b - 2 * least)


def _packed(rows: dict[str, np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Listed rows by the buckets of their groups: a row ``(bucket, base, ...)`` holds each column of a bucket's rows as bytes."""
    bucket = (_mixed(rows["group"]) % U(buckets)).astype(np.min_scalar_type(buckets))
    bases = rows["n"] >> 32
    for base in np.unique(bases):
        mine = np.flatnonzero(bases == base)
        order = mine[np.argsort(bucket[mine], kind="stable")]
        of = bucket[order]
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        ends = np.append(starts, len(order))
        columns = [pa.array(of[starts], pa.int32()), pa.array(np.full(len(starts), base << 32), pa.int64())]
        for name, values in rows.items():
            values = (values & 0xFFFFFFFF if name == "n" else values)[order].astype(LISTED.get(name, np.bool_))
            offsets = (ends * values.itemsize).astype(np.int32)
            columns.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)]))
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "base", *rows])


def _unpacked(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns of the rows that ``_packed`` put into buckets."""
    rows = {}
    for name in batch.schema.names[2:]:
        column, kind = batch.column(name), np.dtype(LISTED.get(name, np.bool_))
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        count = int(offsets[-1] - offsets[0]) // kind.itemsize
        rows[name] = np.frombuffer(column.buffers()[2], kind, count, int(offsets[0]))
        if name == "n":
            lengths = np.diff(offsets) // kind.itemsize
            rows["n"] = rows["n"] + np.repeat(batch.column("base").to_numpy(), lengths)
            rows["bucket"] = np.repeat(batch.column("bucket").to_numpy(), lengths)
    return rows


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of listed rows from packed rows sorted by bucket, ``PIECE_ROWS`` or more at a time, cut where a bucket ends; by groups, and there by the lines' numbers."""

    def in_order(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        least = int(rows["n"].min())
        if int(rows["n"].max()) - least < 1 << 32:  # one key sorts several times faster than two
            order = np.argsort((rows["group"].astype(U) << U(32)) | (rows["n"] - least).astype(U))
        else:
            order = np.lexsort((rows["n"], rows["group"]))
        return {c: v[order] for c, v in rows.items() if c != "bucket"}

    held: list[dict[str, np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(_unpacked(batch))
        size += len(held[-1]["n"])
        if size < PIECE_ROWS or held[0]["bucket"][0] == held[-1]["bucket"][-1]:
            continue
        now = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        cut = int(np.searchsorted(now["bucket"], now["bucket"][-1]))
        yield in_order({c: v[:cut] for c, v in now.items()})
        held = [{c: v[cut:].copy() for c, v in now.items()}]
        size -= cut
    if held:
        yield in_order({c: np.concatenate([h[c] for h in held]) for c in held[0]})


def _apart(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ between the signatures of rows; the sets differ in as many words at least."""
    return sum(np.bitwise_count((rows[c][a] ^ rows[c][b]).view(U)).astype(np.int64) for c in ("signature", "second"))


def _passing(rows: dict[str, np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidate pairs within the groups, by their distance there, as ``(later, earlier, apart)``: at one distance no row is twice the later one.

    The rows of a group are sorted by the lines' numbers, the later ones last.
    """
    n = len(rows["group"])
    new = np.ones(n, bool)
    new[1:] = rows["group"][1:] != rows["group"][:-1]
    start = np.nonzero(new)[0]
    lengths = np.diff(np.append(start, n))
    end = np.repeat(start + lengths, lengths)
    number, before = rows["n"], rows["before"]
    size, place = rows["size"], rows["place"]
    live, step = np.arange(n), 1
    while True:
        live = live[live + step < end[live]]
        if not len(live):
            return
        # Lines whose words before this one are equal, too, meet under that word.
        fits = np.minimum(size[live], size[live + step]) >= similarity * np.maximum(size[live], size[live + step]) - 1e-9
        fits &= (before[live] != before[live + step]) | (before[live] == 0)
        a = live[fits]
        b = a + step
        apart = _apart(rows, a, b)
        ok = _possible(size[a], place[a], size[b], place[b], apart, similarity) & (number[a] != number[b])
        if ok.any():
            yield b[ok], a[ok], apart[ok]
        step += 1


def _likeliest(similarity: float):
    """Rows ``(n, x, likeness, many)``: of each line under a word its likeliest earlier candidate, and whether there are others."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches):
            n = len(rows["group"])
            best, other, seen = np.full(n, -1.0), np.zeros(n, np.int64), np.zeros(n, np.int64)
            size, number = rows["size"], rows["n"]
            for later, earlier, apart in _passing(rows, similarity):
                both = size[later] + size[earlier]
                like = (both - apart) / (both + apart)
                seen[later] += 1
                better = (like > best[later]) | ((like == best[later]) & (number[earlier] < other[later]))
                best[later[better]], other[later[better]] = like[better], number[earlier[better]]
            met = seen > 0
            if met.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number[met]), pa.array(other[met]), pa.array(best[met]), pa.array(seen[met] > 1)], ["n", "x", "likeness", "many"]
                )

    return find


def _linked_to_open(similarity: float):
    """Rows ``(bucket, n, size)``: lines with a candidate pair whose later line is open; such lines share a bucket."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches):
            n = len(rows["group"])
            root, met, number = np.arange(n), np.zeros(n, bool), rows["n"]
            for later, earlier, _ in _passing(rows, similarity):
                asked = rows["open"][later].astype(bool)
                later, earlier = later[asked], earlier[asked]
                met[later] = met[earlier] = True
                root = _joined(root, later, earlier)
            if met.any():
                bucket = _mix(number[root].view(U) ^ _mix(rows["group"].astype(U) + U(1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[met].view(np.int64)), pa.array(number[met]), pa.array(rows["size"][met])],
                    ["bucket", "n", "size"],
                )

    return find


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after linking ``a`` and ``b``: the least member of each connected part."""
    while len(a):
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            break
    return root


def _word_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and hashes of the texts' sets of words."""
    words = Words(texts)
    if not len(words.start):
        return np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(0, U)
    parts, sizes = [], np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):  # slices of whole texts, one at least
        upto = max(at + 1, int(np.searchsorted(words.first[1:], words.first[at] + SLICE_WORDS, side="right")))
        low, high = int(words.first[at]), int(words.first[upto])
        if high > low:
            owner, hashes, _ = _distinct(_mix(word_hashes(words, low, high)), words.text[low:high] - at)
            sizes[at:upto] = np.bincount(owner, minlength=upto - at)
            parts.append(hashes)
        at = upto
    return np.cumsum(sizes) - sizes, sizes, np.concatenate(parts)


def _verified(similarity: float):
    """Numbers of the lines that are similar to the candidate that heads their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_group, held = None, np.zeros(0, U)
        for batch in batches:
            if not batch.num_rows:
                continue
            start, size, words = _word_sets(batch.column("text"))
            # The head of the last batch's last group comes first.
            start, size, words = np.append(0, start + len(held)), np.append(len(held), size), np.append(held, words)
            groups = np.stack([batch.column(c).to_numpy() for c in ("x", "salt")], axis=1)
            groups = np.concatenate([[held_group if held_group is not None else (-1, -1)], groups])
            is_head = np.append(True, batch.column("head").to_numpy(zero_copy_only=False).astype(bool))
            head = np.maximum.accumulate(np.where(is_head, np.arange(len(is_head)), 0))
            rows = np.flatnonzero(~is_head & (groups[head] == groups).all(axis=1))
            similar = _pairwise(start, size, words, rows, head[rows], similarity)
            if similar.any():
                numbers = np.append(-1, batch.column("n").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(numbers[rows[similar]]))], ["n"])
            last = head[-1]
            held_group, held = tuple(groups[last].tolist()), words[start[last] : start[last] + size[last]].copy()

    return run


def _pairwise(start: np.ndarray, size: np.ndarray, words: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets ``left[i]`` and ``right[i]`` are similar."""
    similar = np.zeros(len(left), bool)
    total = np.cumsum(size[left] + size[right])
    at = 0
    while at < len(left):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_WORDS, side="right")))
        sets = np.concatenate([left[at:upto], right[at:upto]])
        pair = np.tile(np.arange(upto - at), 2)
        lengths = size[sets]
        word = words[np.repeat(start[sets] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
        pair = np.repeat(pair, lengths)
        tagged = word ^ _mix(_mix(pair.astype(U) + U(1)) + U(0x9E3779B97F4A7C15))
        order = np.argsort(tagged)
        again = tagged[order][1:] == tagged[order][:-1]
        both = np.bincount(pair[order][1:][again], minlength=upto - at)
        similar[at:upto] = both >= similarity * (size[left[at:upto]] + size[right[at:upto]] - both) - 1e-6
        at = upto
    return similar


def _matched(similarity: float):
    """Numbers of the lines of a group of blocks that have an earlier match in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("bucket", "low", "high")):
            low, high = group["low"][0].as_py(), group["high"][0].as_py()
            number, own = np.unique(group["n"].to_numpy(), return_index=True)  # several rows of an id may hold the line
            block = group["block"].to_numpy()[own]
            start, size, words = _word_sets(group["text"].combine_chunks().take(pa.array(own)))
            sets = [words[a : a + n] for a, n in zip(start, size)]
            left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
            if not len(left) or not len(right):
                continue
            linked = _linked(sets, left, right, similarity)
            later_left = (linked & (left[:, None] > right[None, :])).any(axis=1)
            later_right = (linked & (left[:, None] < right[None, :])).any(axis=0)
            gone = np.unique(np.append(left[later_left], right[later_right]))
            if len(gone):
                yield pa.RecordBatch.from_arrays([pa.array(number[gone])], ["n"])

    return run


def kept_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(id, n_lines, kept)``: lines with words of every document that has one, and the numbers (from 0) of those that stay."""
    # Lines end with a blank for ``Words``; the hash of the id finds a line again, whatever the id's type.
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(key)).alias("of"), F.concat(whole(F.col(text)), F.lit(" ")).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    with shuffles_dropped(docs.sparkSession), batches_of(docs.sparkSession, BATCH_BYTES):
        totals, codes = counted(texts.select("id", "text"), id_type)
        lines = _numbered(texts.select("id", "text"), id_type, codes, similarity)
        del codes
        long_lists = _long_lists(lines)
        listed, met = _listed(lines, long_lists, similarity), "n bigint, x bigint, likeness double, many boolean"
        rounds = [stage(_share(listed, turn).mapInArrow(tidy(_likeliest(similarity)), met), "likeliest") for turn in range(ROUNDS)]
        named = functools.reduce(DataFrame.union, rounds).groupBy("n").agg(F.max_by("x", "likeness").alias("x"), (F.max("many") | (F.min("x") != F.max("x"))).alias("many"))
        named = stage(named, "named")
        unstage(*rounds)
        gone = stage(_to_heads(texts, lines, named).mapInArrow(tidy(_verified(similarity)), "n bigint"), "similar")
        still, n_open = stage_counted(named.where("many").select("n").join(gone.distinct(), "n", "left_anti"), "open")
        if n_open:
            more = stage(_to_blocks(texts, lines, long_lists, still, similarity).mapInArrow(tidy(_matched(similarity)), "n bigint"), "matched")
            gone = gone.union(more)
        firsts = lines.select("n", "id", "line").join(gone.distinct().withColumnRenamed("n", "gone"), F.col("n") == F.col("gone"), "left_anti")
        kept = stage(firsts.groupBy(F.col("id").alias("kept_id")).agg(F.sort_array(F.collect_list("line")).alias("kept")), "kept")
        unstage(named, still)
    totals = totals.groupBy("id").agg(F.max("n_lines").alias("n_lines"))
    return totals.join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left").select(
        "id", "n_lines", F.coalesce("kept", F.array().cast("array<int>")).alias("kept")
    )


def _numbered(texts: DataFrame, id_type: str, codes: np.ndarray, similarity: float) -> DataFrame:
    """The distinct lines with their first places, numbered by these."""

    def to_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _line_rows(batch.column("id"), batch.column("text"), codes, similarity)

    rows = texts.mapInArrow(tidy(to_lines), f"id {id_type}, line int, size int, key bigint, signature bigint, second bigint, prefix array<int>, often array<int>")
    # Equal lines are combined before they are shuffled.
    firsts = rows.groupBy("key", "signature").agg(
        F.min(F.struct("id", "line", "size")).alias("f"), *[F.any_value(c).alias(c) for c in ("second", "prefix", "often")]
    )
    firsts = firsts.select("f.id", "f.line", "f.size", "key", "signature", "second", "prefix", "often")
    return row_numbers(firsts, "id", "line", "key", "signature")


def _long_lists(lines: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The words with more than one block of lines, sorted, and their blocks, None without such; only those marked as common can have them.

    There is one at most for ``LIST_ROWS`` listed rows.
    """
    counts = lines.select(F.explode("often").alias("word")).groupBy("word").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("blocks"))
    found = sorted((row["word"], row["blocks"]) for row in counts.where(F.col("blocks") > 1).collect())
    return (np.array([w for w, _ in found], np.int32), np.array([b for _, b in found], np.int64)) if found else None


def _dealt(rows: dict[str, np.ndarray], long_lists: tuple[np.ndarray, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
    """Rows under a word with a long list once for each pair of blocks that has theirs; ``PACKED_ROWS`` at a time, or those of one row."""
    words, blocks_of = long_lists
    word = rows["group"].view(np.int32)
    at = np.minimum(np.searchsorted(words, word), len(words) - 1)
    blocks = np.where(words[at] == word, blocks_of[at], 1)
    block = (_mixed(rows["n"]) % blocks.astype(U)).astype(np.int64)
    total, done = np.cumsum(blocks), 0
    while done < len(total):
        before = int(total[done - 1]) if done else 0
        upto = max(done + 1, int(np.searchsorted(total, before + PACKED_ROWS, side="right")))
        times = blocks[done:upto]
        row = done + np.repeat(np.arange(upto - done), times)
        other = np.arange(len(row)) - np.repeat(total[done:upto] - times - before, times)
        piece = {c: v[row] for c, v in rows.items()}
        pair = _mixed(word[row], np.minimum(block[row], other), np.maximum(block[row], other)).astype(np.uint32)
        piece["group"] = np.where(blocks[row] > 1, pair, piece["group"])
        yield piece
        done = upto


def _listed(lines: DataFrame, long_lists: tuple[np.ndarray, np.ndarray] | None, similarity: float, only: np.ndarray | None = None) -> DataFrame:
    """Lines under their prefix words, packed by buckets of groups of these and sorted by bucket.

    ``only`` is a filter that holds word and size class.  A group is a word, or a hash of a
    word with a long list and two of its blocks: where hashes meet, there are more
    candidates, never fewer.
    """
    asked = "open" in lines.columns
    most = F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9) + 1  # words of a prefix
    count = lines.agg(F.sum(most)).first()[0] or 0
    if long_lists is not None:
        count += LIST_ROWS * int((long_lists[1] ** 2).sum())
    buckets = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(count) // BUCKET_ROWS))

    def under_words(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        prefix = batch.column("prefix")
        ends = prefix.offsets.to_numpy().astype(np.int64)
        lengths = np.diff(ends)
        words = prefix.values.to_numpy()[ends[0] : ends[-1]]
        row = np.repeat(np.arange(batch.num_rows), lengths)
        place = np.arange(len(words)) - np.repeat(ends[:-1] - ends[0], lengths)
        before = np.where(place > 0, np.append(0, words[:-1])[: len(words)], 0).astype(np.int32)
        held = words != 0
        if only is not None:
            held &= _is_set(only, _cell(words, _size_class(batch.column("size").to_numpy(), similarity)[row]))
        row = row[held]
        own = [batch.column(c).to_numpy()[row] for c in ("n", "signature", "second", "size")]
        rows = dict(zip(LISTED, [words[held].view(np.uint32), before[held], *own, place[held]]))
        if asked:
            rows["open"] = batch.column("open").to_numpy(zero_copy_only=False)[row]
        return rows

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for batch in batches:
            rows = under_words(batch)
            for piece in _dealt(rows, long_lists) if long_lists is not None else [rows]:
                held.append(piece)
                size += len(piece["n"])
                if size >= PACKED_ROWS:
                    yield from _packed({c: np.concatenate([h[c] for h in held]) for c in piece}, buckets)
                    held, size = [], 0
        if size:
            yield from _packed({c: np.concatenate([h[c] for h in held]) for c in held[0]}, buckets)

    names = [*LISTED, *(["open"] if asked else [])]
    columns = ", ".join(["bucket int", "base bigint", *(f"{c} binary" for c in names)])
    listed = lines.select("n", "size", "signature", "second", "prefix", *(["open"] if asked else [])).mapInArrow(tidy(spread), columns)
    return listed.repartition("bucket").sortWithinPartitions("bucket")


def _share(listed: DataFrame, turn: int) -> DataFrame:
    """The buckets of one of ``ROUNDS`` rounds; Spark leaves the others out before it shuffles."""
    return listed.where(F.pmod("bucket", F.lit(ROUNDS)) == turn)


def _size_class(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Lines that may be similar are of one class or of neighbouring ones."""
    return np.floor(np.log(sizes) / -np.log(min(similarity, 0.99)) + 1e-6).astype(np.int64)


def _fetched(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``(key, signature, text)`` of the lines that ``asked`` names by ``(of, line, key)``, and of few others."""

    def places(batch: pa.RecordBatch) -> np.ndarray:
        of, line, key = (batch.column(c).to_numpy() for c in ("of", "line", "key"))
        return np.concatenate([_cell(of), _cell(of, line), _cell(of, line, key)])

    bits = _bits(asked.select("of", "line", "key"), places)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_is_set(bits, _cell(batch.column("of").to_numpy()))))
            if not batch.num_rows:
                continue
            lines = Lines(batch.column("text"))
            of = batch.column("of").to_numpy()[lines.text]
            chosen = np.flatnonzero(_is_set(bits, _cell(of, lines.number))) if len(of) else np.zeros(0, np.int64)
            for mine, hashes, owner in lines.slices(chosen):
                owner, word, _ = _distinct(hashes, owner)
                sizes = np.bincount(owner, minlength=len(mine))
                key, signature, _ = _summed(word, np.cumsum(sizes) - sizes)
                key, signature = key.view(np.int64), signature.view(np.int64)
                wanted = np.flatnonzero(_is_set(bits, _cell(of[mine], lines.number[mine], key)))
                wanted = wanted[np.unique(key[wanted], return_index=True)[1]]  # rows with one id repeat lines
                if len(wanted):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[wanted]), pa.array(signature[wanted]), lines.string(mine[wanted])], ["key", "signature", "text"]
                    )

    return texts.select("of", "text").mapInArrow(tidy(fetch), "key bigint, signature bigint, text string")


def _with_words(texts: DataFrame, lines: DataFrame, asked: DataFrame, label: str) -> DataFrame:
    """``asked`` with the text of line ``n``."""
    line = lines.select("n", F.xxhash64("id").alias("of"), "line", "key", "signature")
    placed = stage(asked.join(line, "n"), label)
    return placed.join(_fetched(texts, placed), ["key", "signature"]).select(*asked.columns, "text")


def _to_heads(texts: DataFrame, lines: DataFrame, named: DataFrame) -> DataFrame:
    """Lines with their words behind those of the candidate they name; many lines go to several copies of it."""
    salts = named.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("int").alias("salts"))
    lines_of = named.join(salts, "x").select("x", F.pmod(F.xxhash64("n"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("head"), "n")
    heads = salts.select("x", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("head"), F.col("x").alias("n"))
    held = _with_words(texts, lines, lines_of.union(heads), "named-places")
    return held.repartition("x", "salt").sortWithinPartitions("x", "salt", F.desc("head"))


def _to_blocks(texts: DataFrame, lines: DataFrame, long_lists: tuple[np.ndarray, np.ndarray] | None, still: DataFrame, similarity: float) -> DataFrame:
    """Open lines and their candidates with their words, a group of rows for every pair of blocks of a bucket."""

    def cells(batch: pa.RecordBatch) -> np.ndarray:
        prefix = batch.column("prefix")
        words = prefix.flatten().to_numpy()
        own = np.repeat(_size_class(batch.column("size").to_numpy(), similarity), np.diff(prefix.offsets.to_numpy()))
        words, own = words[words != 0], own[words != 0]
        return np.concatenate([_cell(words, own + near) for near in (-1, 0, 1)])

    only = _bits(lines.select("n", "size", "prefix").join(still, "n", "left_semi").select("size", "prefix"), cells)
    flagged = lines.join(still.select("n", F.lit(True).alias("open")), "n", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    near = stage(_listed(flagged, long_lists, similarity, only=only).mapInArrow(tidy(_linked_to_open(similarity)), "bucket bigint, n bigint, size int"), "near")
    # Buckets that share lines are drawn together, so that few lines travel more than once.
    least = near.groupBy("n").agg(F.min("bucket").alias("least"))
    label = near.join(least, "n").groupBy("bucket").agg(F.min("least").alias("label"))
    merged = stage(near.join(label, "bucket").select(F.col("label").alias("bucket"), "n", "size").distinct(), "merged")
    unstage(near)
    blocks = merged.groupBy("bucket").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_WORDS)).cast("int").alias("blocks")
    )
    dealt = merged.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "n"
    )
    held = _with_words(texts, lines, dealt, "open-places")
    return held.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the removed lines cut out of the texts; a document that loses all its lines with words goes.

    Documents without any such line stay as they are.
    """
    decided = kept_lines(docs, key, text, similarity).select(F.col("id").alias("dedup_id"), F.col("kept").alias("dedup_kept"))
    joined = docs.join(decided, docs[key].eqNullSafe(decided["dedup_id"]), "left")
    stays = joined.where(F.col("dedup_kept").isNull() | (F.size("dedup_kept") > 0))
    parts = F.filter(
        F.split(F.col(text), "\n"),
        lambda line, i: F.array_contains(F.col("dedup_kept"), i) | ~F.rlike(line, F.lit(WORD)),
    )
    cut = F.when(F.col("dedup_kept").isNull(), F.col(text)).otherwise(F.array_join(parts, "\n"))
    return stays.withColumn(text, cut).select(*[F.col(f"`{c}`") for c in docs.columns])
