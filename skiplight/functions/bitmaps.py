"""Vector bitmaps of a row group: plain integers on the driver, ``bit_or`` aggregates on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


class VectorBitmap:
    """Which vectors of a row group hold a match. Positions outside the group are an error."""

    __slots__ = ("size", "bits")

    def __init__(self, size: int, bits: int = 0):
        self.size, self.bits = size, bits

    def _at(self, vector: int) -> int:
        if not 0 <= vector < self.size:
            raise IndexError(f"vector {vector} of {self.size}")
        return 1 << vector

    def set(self, vector: int) -> None:
        self.bits |= self._at(vector)

    def has(self, vector: int) -> bool:
        return bool(self.bits & self._at(vector))

    def is_empty(self) -> bool:
        return not self.bits

    def merge(self, other: VectorBitmap) -> None:
        self.bits |= other.bits

    def count(self) -> int:
        return self.bits.bit_count()

    def positions(self) -> list[int]:
        return [i for i in range(self.bits.bit_length()) if self.bits >> i & 1]


def word_of(vector_in_group: Column) -> Column:
    """Which 64-bit word of the group's bitmap a vector belongs to."""
    return F.floor(vector_in_group / F.lit(WORD)).cast("int")


def match_bits(match: Column, vector_in_group: Column) -> Column:
    """Aggregate: one word of a bitmap, with the bits of vectors that hold a row for which ``match`` is true."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (vector_in_group % F.lit(WORD)).cast("int"))
    return F.bit_or(F.when(match, bit).otherwise(F.lit(0).cast("long")))


def unsigned(word: int) -> int:
    """A word as the aggregate returns it (bit 63 makes a long negative)."""
    return word & (1 << WORD) - 1
