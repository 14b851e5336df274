"""Words and word hashes of whole batches of texts at once.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``, with A-Z lower-cased. Its hash
is a polynomial over its bytes, read off a running sum of the batch, so no word becomes
a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a piece of its own.
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.ones(256, bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(count: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers[0].size < count:
        size = max(count, PIECE) * 5 // 4
        for place, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[place] = np.multiply.accumulate(steps)
    return _powers[0][:count], _powers[1][:count]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the ``n + 1`` offsets of its texts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with about ``size`` bytes of text each."""
    _, offsets = text_bytes(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte of each run of bytes marked ``inside``, and the runs of each text.

    Text ``i`` has the runs in ``bounds[i]:bounds[i + 1]``; none goes beyond its text.
    """
    member = inside[raw]
    first = np.zeros(raw.size + 1, bool)
    first[offsets] = True
    starts = member.copy()
    starts[1:] &= ~member[:-1] | first[1:-1]
    ends = member
    ends[:-1] &= ~ends[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each run of bytes, equal for equal bytes."""
    power, inverse = _power(raw.size)
    sums = (raw.astype(np.uint64) + np.uint64(1)) * power
    np.cumsum(sums, out=sums)
    hashes = sums[ends]
    hashes[starts > 0] -= sums[starts[starts > 0] - 1]
    hashes *= inverse[starts]
    hashes += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(hashes)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)``: all words in order; text ``i`` has those in ``bounds[i]:bounds[i + 1]``."""
    raw, offsets = text_bytes(column)
    if not raw.size:
        return np.empty(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    raw = LOWER[raw]
    starts, ends, bounds = spans(raw, offsets, WORD)
    return span_hashes(raw, starts, ends), bounds
