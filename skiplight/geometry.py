"""How rows are laid out in row groups and vectors."""

from __future__ import annotations

from dataclasses import dataclass

#: Rows of a row group and of a vector.
ROW_GROUP_SIZE, VECTOR_SIZE = 122_880, 2_048


@dataclass(frozen=True)
class Geometry:
    """A row group is a directory of the managed layout; a vector is a run of rows that a Parquet page holds.

    Both are parameters: on very large tables a row group of some ten million rows keeps the number of directories and
    the driver's bitmaps small.
    """

    row_group_size: int = ROW_GROUP_SIZE
    vector_size: int = VECTOR_SIZE

    def __post_init__(self):
        if self.vector_size < 1 or self.row_group_size < 1 or self.row_group_size % self.vector_size:
            raise ValueError("row_group_size must be a positive multiple of vector_size")

    @property
    def vectors_per_group(self) -> int:
        return self.row_group_size // self.vector_size

    def group_of(self, rid: int) -> int:
        return rid // self.row_group_size

    def total_groups(self, rows: int) -> int:
        return -(-rows // self.row_group_size)

    def total_vectors(self, rows: int) -> int:
        """Vectors of so many rows; the last group's are counted up to its end, a partial one as whole."""
        return -(-rows // self.vector_size)

    def groups_of_range(self, first: int, count: int) -> range:
        """Groups that ``count`` rows appended at row ``first`` touch."""
        return range(self.group_of(first), self.group_of(first + count - 1) + 1) if count > 0 else range(0)
