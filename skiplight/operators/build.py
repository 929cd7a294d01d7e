"""Building a cache entry: one aggregation over the columns a predicate uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bitmaps import VectorBitmap, match_bits, unsigned, word_of
from ..geometry import Geometry
from ..plans.pruning import GROUP, VECTOR
from .store import CacheEntry


def bitmap_rows(rows: DataFrame, match: Column, geometry: Geometry) -> DataFrame:
    """(group, word, bits): partial aggregation in each task leaves a row per group and word to shuffle.

    The rows aren't filtered first, so groups without a match appear with empty words.
    """
    inside = F.col(VECTOR) % F.lit(geometry.vectors_per_group)
    return rows.groupBy(F.col(GROUP).alias("g"), word_of(inside).alias("w")).agg(match_bits(F.coalesce(match, F.lit(False)), inside).alias("bits"))


def build_entry(rows: DataFrame, match: Column, geometry: Geometry) -> CacheEntry:
    """Scan ``rows`` (with the hidden columns) once. The driver receives the bitmaps: one word for 64 vectors."""
    groups: dict[int, VectorBitmap] = {}
    for g, w, bits in bitmap_rows(rows, match, geometry).collect():
        found = groups.setdefault(g, VectorBitmap(geometry.vectors_per_group))
        found.bits |= unsigned(bits) << 64 * w
    return CacheEntry(geometry, groups)
