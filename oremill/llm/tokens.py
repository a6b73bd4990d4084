"""SentencePiece encoding and decoding through a table of distinct chunks.

In a model whose pieces never hold a white-space marker behind another character,
no merge crosses the start of a marked word.  A text then falls into chunks (markers
and what follows up to the next marker) that are segmented independently.  Within a
task every distinct chunk is segmented once by the library and the ids are joined
back by position.  The table is a task's own because a table over all tasks would
need every word of the corpus in two shuffles; text stays where it was read here.

Null and empty texts have no ids and decode to the empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.llm.text import sliced, tidy

MARKER = "▁"
CHUNK = re.compile(f"[ {MARKER}]*[^ {MARKER}]+|[ {MARKER}]+")
#: Entries of a task's table; a full table is begun anew.
TABLE_ROWS = 150_000
#: Longer chunks (text without spaces) are segmented where they stand.
LONGEST_KEPT = 64


@lru_cache(maxsize=4)
def load(model: str):
    """The library's processor; raises if the model's pieces or rules cross chunks."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    if any(MARKER in piece.lstrip(MARKER) for piece in pieces):
        raise ValueError("a piece of this model crosses a white-space marker")
    probe = " ﬁ  x  é "  # kept only by a model that normalises nothing
    ids = processor.encode(probe)
    if processor.decode(ids) != probe or processor.id_to_piece(ids[0])[0] != MARKER:
        raise ValueError("the model must keep texts as they are and begin them with a marker")
    if processor.piece_to_id(MARKER) == processor.unk_id():
        raise ValueError("the model has no piece for a lone marker")
    return processor


class ChunkTable:
    """Ids of distinct chunks, by chunk number: ``flat[start[n]:start[n] + length[n]]``."""

    def __init__(self, model: str):
        self.processor = load(model)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start, self.length = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def segment(self, chunks: list[str]) -> list[list[int]]:
        # The library itself puts one marker in front of a text, so each chunk goes without its first.
        alone = self.processor.piece_to_id(MARKER)
        return [ids if chunk[1:] else [alone] for chunk, ids in zip(chunks, self.processor.encode([c[1:] for c in chunks], num_threads=1))]

    def add(self, chunks: list[str]) -> None:
        found = self.segment(chunks)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.number.update(zip(chunks, range(len(self.start), len(self.start) + len(chunks))))
        self.start = np.append(self.start, len(self.flat) + np.cumsum(lengths) - lengths)
        self.length = np.append(self.length, lengths)
        self.flat = np.append(self.flat, np.fromiter((i for ids in found for i in ids), np.int32, int(lengths.sum())))

    def ids(self, texts: list[str | None]) -> pa.Array:
        """One list of ids a text."""
        split = [CHUNK.findall(" " + text) if text else [] for text in texts]
        if len(self.number) > TABLE_ROWS:
            self.clear()
        fresh = {c for chunks in split for c in chunks if c not in self.number}
        long = {c for c in fresh if len(c) > LONGEST_KEPT}
        self.add(list(fresh))
        numbers = np.fromiter((self.number[c] for chunks in split for c in chunks), np.int64)
        for chunk in long:
            del self.number[chunk]
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[numbers] - (ends - lengths), lengths) + np.arange(total)]
        last = np.cumsum([0, *map(len, split)])
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends)[last], pa.int32()), pa.array(ids, pa.int32()))


def encoded(text: Column, model: str) -> Column:
    """Array of ids, exactly those of the library's ``encode``."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ChunkTable(model)
        for batch in batches:
            yield pa.concat_arrays([table.ids(part) for part in sliced(batch)])

    return ids(text.cast("string"))


def decoded(ids: Column, model: str) -> Column:
    """The text of an array of ids by the library's ``decode``; empty for null or no ids."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        processor = load(model)
        for batch in batches:
            yield pa.array((processor.decode(x.as_py()) if x.is_valid and len(x) else "" for x in batch), pa.string(), size=len(batch))

    return texts(ids)


def round_trip(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of the texts and what they decode to, by one Python worker a task."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    @tidy
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ChunkTable(model)
        for batch in batches:
            parts = [table.ids(part) for part in sliced(batch)]
            texts = [table.processor.decode(x.as_py()) if len(x) else "" for part in parts for x in part]
            yield pa.StructArray.from_arrays([pa.concat_arrays(parts), pa.array(texts, pa.string())], ["ids", "decoded"])

    found = docs.withColumn("round_trip_found", both(F.col(text).cast("string")))
    return found.withColumn(ids, F.col("round_trip_found.ids")).withColumn(decoded, F.col("round_trip_found.decoded")).drop("round_trip_found")


def encode_documents(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of ids, which replaces one of the same name."""
    return docs.withColumn(ids, encoded(F.col(text), model))


def decode_documents(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    return docs.withColumn(text, decoded(F.col(ids), model))
