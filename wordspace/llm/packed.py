"""Sorted integer keys with counts as compressed blocks, and their merging.

A task hands on one row per bucket with the keys it saw, each once; buckets are merged
by Spark groups. Differences of sorted keys are small, so a key takes about half its
eight bytes in the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = pa.schema([("bucket", pa.int64()), ("rows", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
BLOCK_DDL = "bucket bigint, rows bigint, keys binary, counts binary"



def squeeze(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(planes), asbytes=True) if values.size else b""


def unsqueeze(data: bytes, count: int, dtype) -> np.ndarray:
    if not count:
        return np.empty(0, dtype)
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=count * width), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, count).T).view(dtype).ravel()


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sum of the counts (else the number) of each."""
    if not keys.size:
        return keys, np.empty(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    total = np.diff(np.append(first, keys.size)) if counts is None else np.add.reduceat(counts, first)
    return keys[first], total.astype(np.int64)


class Tally:
    """Counts of keys added bit by bit, in bounded memory: ``add`` returns what has to leave."""

    def __init__(self, room: int = 1 << 22):
        self.room, self.loose, self.waiting = room, [], 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.loose.append(keys)
        self.waiting += keys.size
        if self.waiting < self.room:
            return None
        self._settle()
        if self.keys.size < 2 * self.room:
            return None
        return self.take()

    def _settle(self) -> None:
        keys, counts = tally(np.concatenate(self.loose)) if self.loose else (self.keys[:0], self.counts[:0])
        self.loose, self.waiting = [], 0
        self.keys, self.counts = tally(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._settle()
        out = self.keys, self.counts
        self.keys, self.counts = self.keys[:0], self.counts[:0]
        return out


def blocks(keys: np.ndarray, counts: np.ndarray, buckets: np.ndarray) -> pa.RecordBatch:
    """Rows of ``BLOCK``, one per bucket; keys come sorted."""
    order = np.argsort(buckets, kind="stable")
    keys, counts, buckets = keys[order], counts[order], buckets[order]
    first = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if keys.size else np.empty(0, int)
    rows = []
    for begin, end in zip(first, np.append(first[1:], keys.size)):
        steps = np.diff(keys[begin:end], prepend=np.uint64(0))
        rows.append((int(buckets[begin]), end - begin, squeeze(steps), squeeze(counts[begin:end])))
    columns = zip(*rows) if rows else ([],) * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, BLOCK)], schema=BLOCK)


def unpack(rows: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unsqueeze(keys, rows, np.uint64), dtype=np.uint64), unsqueeze(counts, rows, np.int64)


def merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All blocks of one bucket added up."""
    parts = [
        unpack(n.as_py(), k.as_py(), c.as_py())
        for n, k, c in zip(table.column("rows"), table.column("keys"), table.column("counts"))
    ]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
