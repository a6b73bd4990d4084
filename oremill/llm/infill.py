"""Fill-in-the-middle: texts cut at two unit ends and put in another order.

A unit is a word with the white space before it, or white space at the end of a text.
The UTF-8 bytes of an Arrow batch are viewed as 64-bit words.  Unit-ending bytes (not
blank, with a blank behind; and the last byte of every text) are marked in the high bits
by arithmetic on whole words, counted per word with ``bitwise_count`` and summed up.  The
byte after the k-th unit is then a search for the word that reaches the k-th mark, and a
select within it.  Continuation bytes are marked the same way to turn bytes into code
points.  Only counts and cut points leave Python; texts are put together by Spark.

The cuts and the form follow from the first four 8-digit groups h1 to h4 of the hex
sha256 of ``<seed>:<id>``: prefix and middle end after the smaller and the larger of
h1 % (n + 1) and h2 % (n + 1) units; with h3 % 100 below ``rate`` the text is transformed,
suffix first (``spm``) if h4 % 100 is below ``suffix_first``, else prefix first (``psm``).

Odd rows: a null text is empty; an empty text, or one that holds a marker, stays
``plain``.  A null id is hashed as an empty text.  Rows are independent: equal rows get
equal results, rows of one id the same draws.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.llm.text import whole

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE = 50
SUFFIX_FIRST = 80

U = np.uint64


def _every(byte: int) -> np.uint64:
    """A word that holds the byte eight times."""
    return U(byte * 0x0101010101010101)


ONES, HIGH, LOW = _every(0x01), _every(0x80), _every(0x7F)


def blanks(x: np.ndarray) -> np.ndarray:
    """High bits of the bytes 0x20 and 0x09 to 0x0D."""
    y = x & LOW  # sums of seven-bit values stay within their bytes
    other = (y ^ _every(0x20)) + LOW
    from_tab, past_return = y + _every(0x80 - 0x09), y + _every(0x80 - 0x0E)
    return (~other | (from_tab & ~past_return)) & ~x & HIGH


def unit_ends(x: np.ndarray) -> np.ndarray:
    """High bits of the bytes that are not blank and have a blank behind them."""
    blank = blanks(x)
    behind = blank >> U(8)
    behind[:-1] |= blank[1:] << U(56)
    return ~blank & behind & HIGH


def characters(x: np.ndarray) -> np.ndarray:
    """High bits of the bytes that start a code point."""
    return ~(x & ~(x << U(1))) & HIGH


class Marks:
    """Rank and select over marks in the high bits of bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.cumsum(np.bitwise_count(marks), dtype=np.int64)

    def rank(self, byte: np.ndarray) -> np.ndarray:
        """Marks before each byte."""
        word, bits = byte >> 3, (8 * (byte & 7)).astype(U)
        part = np.bitwise_count(self.marks[word] & ((U(1) << bits) - U(1))).astype(np.int64)
        return self.upto[word] - np.bitwise_count(self.marks[word]) + part

    def behind(self, nth: np.ndarray) -> np.ndarray:
        """The byte behind the nth mark, counted from 1."""
        word = np.searchsorted(self.upto, nth)
        mark = self.marks[word]
        left = (nth - (self.upto[word] - np.bitwise_count(mark))).astype(U)
        # Multiplying sums the marks of the lower bytes into each byte; a byte's high bit is set where they reach ``left``.
        reached = (mark >> U(7)) * ONES + (U(0x80) - left) * ONES
        return word * 8 + 8 - np.bitwise_count(reached & HIGH) + 1


def cut_points(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and code points of its prefix and of its middle for two draws."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    start, end = ends[:-1] - ends[0], ends[1:] - ends[0]
    size = int(ends[-1] - ends[0])
    x = np.zeros(size // 8 + 1, U)  # a byte more than the texts, so that every end has a word
    if size:
        x.view(np.uint8)[:size] = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    marks = unit_ends(x)
    full = end > start
    last = end[full] - 1
    # Marked whatever the next text begins with; no other byte looks beyond its own text.
    np.bitwise_or.at(marks, last >> 3, U(0x80) << (8 * (last & 7)).astype(U))
    units, chars = Marks(marks), Marks(characters(x))
    before = units.rank(start)
    n = units.rank(end) - before
    a, b = first % (n + 1), second % (n + 1)

    def chars_of(k: np.ndarray) -> np.ndarray:
        byte = start.copy()
        some = k > 0
        byte[some] = units.behind(before[some] + k[some])
        return chars.rank(byte) - chars.rank(start)

    prefix, both = chars_of(np.minimum(a, b)), chars_of(np.maximum(a, b))
    return n, prefix, both - prefix


def cuts(text: Column, first: Column, second: Column) -> Column:
    """``cut_points`` as a column ``struct<n, prefix, middle>``."""

    @F.arrow_udf("struct<n: bigint, prefix: bigint, middle: bigint>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, a, b in batches:
            found = cut_points(texts, a.to_numpy(), b.to_numpy())
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in found], ["n", "prefix", "middle"])

    return cut(text, first, second)


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def transformed(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for every row; the lengths are null for plain texts."""
    h1, h2, h3, h4 = draws(F.col(key), seed)
    mine = docs.select(F.col(key).alias("doc_id"), whole(F.col(text)).alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    cut = mine.withColumn("c", cuts(F.col("text"), F.col("h1"), F.col("h2")))
    held = F.contains(F.col("text"), F.lit(PREFIX)) | F.contains(F.col("text"), F.lit(SUFFIX)) | F.contains(F.col("text"), F.lit(MIDDLE))
    plain = (F.col("text") == "") | held | (F.col("h3") % 100 >= rate)
    form = F.when(plain, F.lit("plain")).when(F.col("h4") % 100 < suffix_first, F.lit("spm")).otherwise(F.lit("psm"))
    shaped = cut.select("doc_id", "text", "c.n", form.alias("form"), F.col("c.prefix").alias("p"), F.col("c.middle").alias("m"))

    def part(start: Column, length: Column | None = None) -> Column:
        return F.substring("text", (start + 1).cast("int"), (F.lit(2**31 - 1) if length is None else length).cast("int"))

    prefix, middle, suffix = part(F.lit(0), F.col("p")), part(F.col("p"), F.col("m")), part(F.col("p") + F.col("m"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    )
    moved = F.col("form") != "plain"
    return shaped.select(
        "doc_id", "n", "form", F.when(moved, F.col("p")).alias("prefix_chars"), F.when(moved, F.col("m")).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: neither text nor the seams can hold another marker, so the three split it."""
    parts = F.split(output, "<[PSM]>", -1)
    prefix, suffix = F.when(form == "psm", parts[1]).otherwise(parts[2]), F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))
