"""Removal of repeated passages: exact windows of words, counted in super-k-mers.

A window is ``window`` consecutive words of one document.  Its minimiser is the least
hash among its ``GRAM``-word grams, so equal windows have equal minimisers, and
consecutive windows mostly share theirs.  A maximal run of windows with one minimiser
travels as one packed string (its words, joined by blanks) to the bucket of the
minimiser, where the windows of all strings are sorted and the earliest start of each
is found.  Every word covered by a window whose words also start earlier goes.

Steps, all over the whole table:

1. ``shared_cells``: a run whose minimiser occurs once in the table, at one place in the
   run, repeats nothing and stays at home.  Minimisers are counted as seen once or twice in ``2 ** CELL_BITS`` cells, a
   table of 16 MB whatever the corpus; where cells collide, or once they fill up, more
   strings travel and the result stays the same.
2. Equal strings are combined before they are shuffled: one row with the earliest place.
   A string's other places lose all their windows.
3. Buckets of at most ``BUCKET_STRINGS`` distinct strings are sorted in one piece.  The
   strings of a larger bucket (the ends of a passage that many texts quote) are cut
   into single windows, which Spark groups like any other key, combined before the shuffle.
4. What each string loses goes back to its places, and from there to the documents.

Strings are told apart by a 128-bit digest, windows within a bucket by their bytes.

Order and odd rows: "earlier" is a smaller id, then a smaller start.  Null ids count as
the largest integer, so they come last.  Unlike texts with one id are documents in the
order of a hash of their texts; equal rows are one document and get the same result.
A null text, like one without a word, has no words and stays empty; a text of fewer
words than a window repeats nothing.  Other columns of the table are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oremill.llm.text import stage_clean, whole
from oremill.plans.staging import unstage

WINDOW = 20
GRAM = 5
CELL_BITS = 27
BLOCK_BITS = 16
BUCKET_STRINGS = 4096
#: Words that a task hashes at once.
SLICE_WORDS = 200_000
#: Minimisers that a task holds before it hands them on.
HELD = 4_000_000

U = np.uint64
LAST_ID = (1 << 63) - 1
ODD = U(0x9E3779B97F4A7C15)
ODD_INVERSE = U(pow(int(ODD), -1, 1 << 64))

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

PLACE = "id bigint, mark bigint, start int"
RUNS = "runs array<struct<at: int, n: int>>"


class Words:
    """The words of Arrow strings that all end with a blank: bounds in ``data``, and each text's first word."""

    def __init__(self, texts: pa.Array):
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        blank = BLANK[self.data]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(blank) and not blank[0]:
            edges = np.append(0, edges)
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, ends - ends[0])
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))


@lru_cache(4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(size, ODD)), np.cumprod(np.full(size, ODD_INVERSE))


def word_hashes(words: Words, low: int, high: int) -> np.ndarray:
    """A hash of each word in [low, high), from one running sum over their bytes."""
    start, end = words.start[low:high], words.end[low:high]
    piece = words.data[start[0] : end[-1]].astype(U) + U(1)
    powers, inverse = _powers(1 << int(len(piece)).bit_length())
    sums = np.append(U(0), np.cumsum(piece * powers[: len(piece)]))
    hashed = (sums[end - start[0]] - sums[start - start[0]]) * inverse[start - start[0]]
    return hashed ^ (hashed >> U(31))


def gram_hashes(hashes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram that starts at each word."""
    mixed = np.full(len(hashes) - gram + 1, U(gram))
    for k in range(gram):
        mixed = (mixed ^ hashes[k : len(hashes) - gram + 1 + k]) * U(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> U(29)
    return mixed


def least_of(grams: np.ndarray, wanted: int) -> np.ndarray:
    """The least of the ``wanted`` grams from each place on, by spans that double."""
    span = 1
    while span < wanted:
        step = min(span, wanted - span)
        grams = np.minimum(grams[:-step], grams[step:])
        span += step
    return grams


def runs_of(words: Words, window: int, slice_words: int = SLICE_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By slices of the words: the runs' first windows, counts of windows, minimisers, and whether one may hold a window twice.

    Equal windows in one run have their minimiser at two places, and the places of one
    minimiser in a run are at most ``window - gram + 1`` words apart.
    """
    gram = min(GRAM, window)
    spread = window - gram + 1
    total = len(words.start)
    for low in range(0, max(0, total - window + 1), slice_words):
        high = min(total, low + slice_words + window - 1)
        grams = gram_hashes(word_hashes(words, low, high), gram)
        least = least_of(grams, spread)
        again = np.zeros(len(grams) + 1, np.int64)
        for apart in range(1, min(spread, len(grams) - 1) + 1):
            again[apart + 1 :] |= grams[apart:] == grams[:-apart]
        again = np.cumsum(again)
        inside = np.flatnonzero(words.text[low : low + len(least)] == words.text[low + window - 1 : high])
        if not len(inside):
            continue
        new = np.ones(len(inside), bool)
        new[1:] = (inside[1:] != inside[:-1] + 1) | (least[inside[1:]] != least[inside[:-1]])
        at = np.flatnonzero(new)
        first, n = inside[at], np.diff(np.append(at, len(inside)))
        yield first + low, n, least[first], again[first + n + spread - 1] > again[first + 1]


def _ended(text: str) -> F.Column:
    return F.concat(whole(F.col(text)), F.lit(" "))


def _cells(least: np.ndarray, cell_bits: int) -> np.ndarray:
    return (least & U((1 << cell_bits) - 1)).astype(np.int64)


def shared_cells(texts: DataFrame, window: int, cell_bits: int = CELL_BITS) -> np.ndarray:
    """A bit for each cell in which two runs or more fall."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, least, double in runs_of(Words(batch.column(0)), window):
                held += [_cells(least, cell_bits), _cells(least[double], cell_bits)]
                size += len(least)
                if size >= HELD:
                    yield packed(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield packed(np.concatenate(held))

    def packed(cells: np.ndarray) -> pa.RecordBatch:
        """Rows of a block of cells each: the cells' low digits, those seen more than once twice."""
        cells, counts = np.unique(cells, return_counts=True)
        cells = np.repeat(cells, np.minimum(counts, 2))
        blocks, starts = np.unique(cells >> BLOCK_BITS, return_index=True)
        low = (cells & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
        return pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array([part.tobytes() for part in np.split(low, starts[1:])], pa.binary())], ["block", "cells"]
        )

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((block, cells) for b in batches for block, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for block, parts in groupby(rows, itemgetter(0)):
            counts = np.zeros(1 << BLOCK_BITS, np.uint8)
            for _, cells in parts:
                counts = np.minimum(2, counts + np.bincount(np.frombuffer(cells, np.uint16), minlength=len(counts))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())], ["block", "bits"]
            )

    parts = texts.select("text").mapInArrow(seen, "block int, cells binary").repartition("block").sortWithinPartitions("block")
    bits = np.zeros((1 << cell_bits - BLOCK_BITS, (1 << BLOCK_BITS) // 8), np.uint8)
    for row in parts.mapInArrow(twice, "block int, bits binary").collect():
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.ravel()


def super_kmers(texts: DataFrame, window: int, cell_bits: int = CELL_BITS) -> DataFrame:
    """``(id, mark, start, n, least, digest, words)``: the runs whose minimiser may occur elsewhere, with their packed words."""
    cells = texts.sparkSession.sparkContext.broadcast(shared_cells(texts, window, cell_bits))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = cells.value
        for batch in batches:
            words = Words(batch.column("text"))
            raw = memoryview(words.data)
            for at, n, least, _ in runs_of(words, window):
                cell = _cells(least, cell_bits)
                shared = (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
                at, n, least = at[shared], n[shared], least[shared]
                text = words.text[at]
                bounds = zip(words.start[at].tolist(), words.end[at + n + window - 2].tolist())
                strings = [b" ".join(bytes(raw[a:b]).split()) for a, b in bounds]
                digests = [hashlib.blake2b(s, digest_size=16).digest() for s in strings]
                of = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(of),
                        batch.column("mark").take(of),
                        pa.array(at - words.first[text], pa.int32()),
                        pa.array(n, pa.int32()),
                        pa.array(least.view(np.int64)),
                        pa.array(digests, pa.binary()),
                        pa.array(strings, pa.binary()),
                    ],
                    ["id", "mark", "start", "n", "least", "digest", "words"],
                )

    return texts.mapInArrow(cut, f"{PLACE}, n int, least bigint, digest binary, words binary")


def windows_of(words: bytes, window: int) -> list[bytes]:
    """The windows of a packed string, in order."""
    ends = [*accumulate(len(w) + 1 for w in words.split(b" "))]
    return [words[start : end - 1] for start, end in zip([0, *ends], ends[window - 1 :])]


def _runs(offsets: list[int]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for at in offsets:
        if out and out[-1]["at"] + out[-1]["n"] == at:
            out[-1]["n"] += 1
        else:
            out.append({"at": at, "n": 1})
    return out


def later_windows(strings: DataFrame, window: int) -> DataFrame:
    """``(digest, id, mark, start, runs)``: of each string's first place, the windows that start earlier elsewhere.

    ``strings`` is ``(least, digest, words, id, mark, start)``; the strings of a bucket are in one group.
    """
    kinds = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("least", "digest", "words", "id", "mark", "start"))))
        out = []
        for _, bucket in groupby(rows, itemgetter(0)):
            strings_here = list(bucket)
            found = sorted(
                (piece, doc, mark, start + k, at)
                for at, (_, _, words, doc, mark, start) in enumerate(strings_here)
                for k, piece in enumerate(windows_of(words, window))
            )
            later: dict[int, list[int]] = {}
            for before, now in zip(found, found[1:]):
                if now[0] == before[0]:
                    later.setdefault(now[4], []).append(now[3] - strings_here[now[4]][5])
            for at, (_, digest, _, doc, mark, start) in enumerate(strings_here):
                out.append((digest, doc, mark, start, _runs(sorted(later.get(at, [])))))
            if len(out) >= 10_000:
                yield told(out)
                out = []
        if out:
            yield told(out)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["digest", "id", "mark", "start", "runs"])

    dealt = strings.repartition("least").sortWithinPartitions("least")
    return dealt.mapInArrow(sort, f"digest binary, {PLACE}, {RUNS}")


def later_single_windows(strings: DataFrame, window: int) -> DataFrame:
    """``later_windows`` for strings of very large buckets: their windows are grouped one by one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [windows_of(words, window) for words in batch.column("words").to_pylist()]
            of = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
            kept = [batch.column(c).take(pa.array(of)) for c in ("digest", "id", "mark", "start")]
            offsets = np.concatenate([np.arange(len(p)) for p in pieces] or [np.zeros(0, np.int64)])
            digests = [hashlib.blake2b(piece, digest_size=16).digest() for p in pieces for piece in p]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(offsets, pa.int32()), pa.array(digests, pa.binary())], ["digest", "id", "mark", "start", "k", "window"])

    single = strings.mapInArrow(cut, f"digest binary, {PLACE}, k int, window binary")
    place = F.struct("id", "mark", (F.col("start") + F.col("k")).alias("at"))
    firsts = single.groupBy("window").agg(F.min(place).alias("first"))
    judged = single.join(firsts, "window").withColumn("k", F.when(place != F.col("first"), F.col("k")))
    return judged.groupBy("digest", "id", "mark", "start").agg(
        F.transform(F.sort_array(F.collect_list("k")), lambda k: F.struct(k.alias("at"), F.lit(1).alias("n"))).alias("runs")
    )


def repeated_runs(
    texts: DataFrame, window: int = WINDOW, bucket_strings: int = BUCKET_STRINGS, cell_bits: int = CELL_BITS
) -> DataFrame:
    """``(id, mark, runs)``: of every document that repeats something, the runs of windows that start earlier elsewhere.

    ``texts`` is ``(id, mark, text)``, every text ending with a blank.
    """
    travelling = stage_clean(super_kmers(texts, window, cell_bits), "super-kmers")
    strings = travelling.groupBy("least", "digest").agg(
        F.min(F.struct("id", "mark", "start")).alias("first"), F.any_value("words").alias("words")
    )
    strings = stage_clean(strings.select("least", "digest", "words", "first.*"), "strings")
    large = stage_clean(strings.groupBy("least").agg(F.count("*").alias("strings")).where(F.col("strings") > bucket_strings), "large")
    later = later_windows(strings.join(large, "least", "left_anti"), window).unionByName(
        later_single_windows(strings.join(large, "least", "left_semi"), window)
    )
    later = stage_clean(later, "later")
    first = later.select("digest", F.struct("id", "mark", "start").alias("first"), "runs")
    places = travelling.select("digest", "id", "mark", "start", "n").join(first, "digest")
    all_of_it = F.array(F.struct(F.lit(0).alias("at"), F.col("n").alias("n")))
    of_place = F.when(F.struct("id", "mark", "start") == F.col("first"), F.col("runs")).otherwise(all_of_it)
    moved = F.transform(of_place, lambda r: F.struct((r["at"] + F.col("start")).alias("at"), r["n"].alias("n")))
    losing = places.select("id", "mark", moved.alias("runs")).where(F.size("runs") > 0)
    lost = stage_clean(losing.groupBy("id", "mark").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")
    unstage(travelling, strings, large, later)
    return lost


def without_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    bucket_strings: int = BUCKET_STRINGS,
    cell_bits: int = CELL_BITS,
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every row: its words, those removed, and the rest joined by blanks."""
    mine = docs.select(
        F.col(key).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(key).cast("bigint"), F.lit(LAST_ID)).alias("id"),
        F.xxhash64(whole(F.col(text))).alias("mark"),
        _ended(text).alias("text"),
    )
    runs = repeated_runs(mine.select("id", "mark", "text"), window, bucket_strings, cell_bits)

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost = batch.column("runs")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *_trimmed(Words(batch.column("text")), lost, window)], ["doc_id", "n_words", "n_removed", "kept"]
            )

    met = mine.join(runs, ["id", "mark"], "left").select("doc_id", "text", "runs")
    return met.mapInArrow(trim, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def _trimmed(words: Words, lost: pa.Array, window: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Counts of words and of removed words, and the kept words joined by blanks."""
    flat = lost.flatten()
    of = np.repeat(np.arange(len(lost)), lost.value_lengths().fill_null(0).to_numpy())
    begin = words.first[of] + flat.field("at").to_numpy().astype(np.int64)
    change = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + flat.field("n").to_numpy() + window - 1, -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    text = words.text[kept]
    last = np.ones(len(kept), bool)
    last[:-1] = text[1:] != text[:-1]
    # The byte behind a word is the blank that follows it, unless nothing does.
    taken = np.zeros(len(words.data) + 1, np.int8)
    upto = words.end[kept] + ~last
    np.add.at(taken, words.start[kept], 1)
    np.add.at(taken, upto, -1)
    taken = np.cumsum(taken[:-1], dtype=np.int8) > 0
    data = np.where(BLANK[words.data], np.uint8(0x20), words.data)[taken]
    ends = np.append(0, np.cumsum(np.bincount(text, (upto - words.start[kept]), len(lost)).astype(np.int64)))
    strings = pa.StringArray.from_buffers(len(lost), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
    total = np.diff(words.first)
    return pa.array(total, pa.int64()), pa.array(total - np.bincount(text, minlength=len(lost)), pa.int64()), strings
