"""Parameters of a vector space and the column type of its vectors."""

from __future__ import annotations

from dataclasses import dataclass

# The defaults a lexicon has when nothing else was stored for it.
DEFAULT_SIZE = 16000
DEFAULT_K = 48
DEFAULT_RADIUS = 3

INT_VECTOR = "struct<dims:array<int>,vals:array<bigint>>"
REAL_VECTOR = "struct<dims:array<int>,vals:array<double>>"

# Vectors on their way between two steps of a sum.
PACKED_INT = "struct<dims:binary,ints:binary>"
PACKED_REAL = "struct<dims:binary,reals:binary>"


@dataclass(frozen=True)
class VectorSpace:
    """``size`` dimensions, ``k`` non-zeros per index vector, window ``radius``."""

    size: int = DEFAULT_SIZE
    k: int = DEFAULT_K
    radius: int = DEFAULT_RADIUS

    def __post_init__(self):
        if self.k < 2 or self.k % 2 or self.k > self.size:
            raise ValueError(f"k must be even and within 2..size, got k={self.k} size={self.size}")
        if self.radius < 0:
            raise ValueError(f"radius must not be negative, got {self.radius}")
