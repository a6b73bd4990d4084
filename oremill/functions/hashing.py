"""Hash families, trailing zeros and reproducible random draws as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slopes and offsets of the ten hash functions, and the moduli
# of the compact family.
SLOPES = (45461, 30837, 44899, 34438, 44836, 30873, 43431, 42622, 47150, 48585)
OFFSETS = (44753, 35708, 35981, 44966, 48709, 30917, 44730, 35824, 48923, 47731)
COMPACT_PRIME = 11299
COMPACT_BITS = 69997

WIDE_PRIME = 2147483647  # 2^31 - 1


@dataclass(frozen=True)
class HashFamily:
    """``h_i(x) = ((slope_i * x + offset_i) mod prime) mod buckets``."""

    slopes: tuple[int, ...]
    offsets: tuple[int, ...]
    prime: int
    buckets: int

    def __post_init__(self) -> None:
        if len(self.slopes) != len(self.offsets) or not self.slopes:
            raise ValueError("slopes and offsets must be non-empty and of one length")
        if not 1 < self.prime < 2**31:
            raise ValueError("prime must be below 2^31 so that products fit a bigint")

    def __len__(self) -> int:
        return len(self.slopes)


def compact_family() -> HashFamily:
    """Offsets equal to slopes and a small prime: only 11,299 distinct values.

    Beyond a few thousand distinct users nearly every bit is set; use
    :func:`wide_family` for large streams.
    """
    return HashFamily(SLOPES, SLOPES, COMPACT_PRIME, COMPACT_BITS)


def wide_family(buckets: int) -> HashFamily:
    return HashFamily(SLOPES, OFFSETS, WIDE_PRIME, buckets)


def utf8_int_mod(value: Column, modulus: int) -> Column:
    """The big-endian integer of the UTF-8 bytes of ``value``, modulo ``modulus``.

    The bytes are folded four at a time, so the accumulator stays below
    ``modulus * 2^32`` and fits a bigint.
    """
    digits = F.hex(F.encode(value, "UTF-8"))
    width = (F.ceil(F.length(digits) / F.lit(8)) * 8).cast("int")
    words = F.regexp_extract_all(F.lpad(digits, width, F.lit("0")), F.lit("(.{8})"), F.lit(1))
    return F.aggregate(
        words,
        F.lit(0).cast("bigint"),
        lambda acc, word: (acc * F.lit(2**32) + F.conv(word, 16, 10).cast("bigint")) % F.lit(modulus),
    )


def hash_values(residue: Column, family: HashFamily) -> list[Column]:
    """One bigint column per hash function, from ``utf8_int_mod(value, family.prime)``."""
    return [
        ((F.lit(a) * residue + F.lit(b)) % F.lit(family.prime)) % F.lit(family.buckets)
        for a, b in zip(family.slopes, family.offsets)
    ]


def trailing_zeros(value: Column) -> Column:
    """Trailing zeros of the binary form; zero, printed as a single ``0``, has one."""
    lowest = value.bitwiseAND(-value)
    return F.when(value == 0, F.lit(1)).otherwise(F.bit_count(lowest - 1)).cast("int")


def draw32(seed: int, number: Column, stream: int = 0) -> Column:
    """A uniform integer in [0, 2^32) that depends only on (seed, number, stream)."""
    if not 0 <= stream < 4:
        raise ValueError("stream must be 0..3")
    return _digits(seed, number, 8 * stream + 1, 8)


def draw48(seed: int, number: Column) -> Column:
    """A uniform integer in [0, 2^48), made of the same digits as ``draw32``'s first two streams."""
    return _digits(seed, number, 1, 12)


def _digits(seed: int, number: Column, first: int, count: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), number.cast("string")))
    return F.conv(F.substring(digest, first, count), 16, 10).cast("bigint")
