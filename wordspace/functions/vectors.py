"""Sparse vectors as columns.

A vector is ``struct<dims array<int>, vals array<...>>`` with ascending ``dims``
and no zero cells; the zero vector has empty arrays. Two flat arrays cost 12 bytes
a cell in a shuffled row where an array of structs costs 32.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from wordspace.space import VectorSpace


def index_vector(word: Column, space: VectorSpace) -> Column:
    """The fixed random vector of a word: one +1 or -1 in each of ``k`` equal blocks.

    Block ``i`` takes its offset from the first 32 bits of ``md5(word#i)``. Blocks
    come in pairs of opposite sign, the second 32 bits of ``md5(word#(i div 2))``
    telling which of the pair is negative.
    """
    size, k = space.size, space.k
    blocks = F.sequence(F.lit(0), F.lit(k - 1))
    digests = F.transform(blocks, lambda i: F.md5(F.concat(word, F.lit("#"), i.cast("string"))))

    def build(d: Column) -> Column:
        def dim(digest: Column, i: Column) -> Column:
            start = F.floor(i * size / k)
            width = F.floor((i + 1) * size / k) - start
            return (start + F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("bigint") % width).cast("int")

        def sign(_: Column, i: Column) -> Column:
            nibble = F.conv(F.substr(F.get(d, F.floor(i / 2).cast("int")), F.lit(16), F.lit(1)), 16, 10)
            return (1 - 2 * ((nibble.cast("bigint") + i) % 2)).cast("bigint")

        return F.struct(F.transform(d, dim).alias("dims"), F.transform(d, sign).alias("vals"))

    # A one-element transform names the digests, so they are computed once.
    return F.get(F.transform(F.array(digests), build), F.lit(0))


# Fixed values of the digest (RFC 1321): how far each step turns, its constant, and the state at the start.
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_CONSTANTS = [np.uint32(int(abs(math.sin(step + 1)) * 2**32)) for step in range(64)]
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a message that fit one block, and messages digested at once, so that all stays in the cache.
_ONE_BLOCK, _AT_ONCE = 55, 1 << 14


def _digests(block: np.ndarray) -> np.ndarray:
    """The first eight bytes of the MD5 digests of padded messages, as two numbers each; ``block`` is 16 x messages."""
    a, b, c, d = (np.full(block.shape[1], value, np.uint32) for value in _STATE)
    for step in range(64):
        if step < 16:
            mixed, word = d ^ (b & (c ^ d)), step
        elif step < 32:
            mixed, word = c ^ (d & (b ^ c)), (5 * step + 1) % 16
        elif step < 48:
            mixed, word = b ^ c ^ d, (3 * step + 5) % 16
        else:
            mixed, word = c ^ (b | ~d), 7 * step % 16
        mixed += a
        mixed += block[word]
        mixed += _CONSTANTS[step]
        turn = np.uint32(_TURNS[step])
        a, d, c, b = d, c, b, b + (mixed << turn | mixed >> (np.uint32(32) - turn))
    return np.stack((a + np.uint32(_STATE[0]), b + np.uint32(_STATE[1])), axis=-1).byteswap()


def _numbered_digests(names: list[bytes], k: int) -> np.ndarray:
    """The first two 32-bit numbers of ``md5(name#i)`` for each name and ``i < k``; one digest at a time costs ten times as much."""
    out = np.empty((len(names), k, 2), np.uint32)
    sizes = np.array([len(name) for name in names], np.int64)
    short = np.flatnonzero(sizes + 1 + len(str(k - 1)) <= _ONE_BLOCK)
    step = max(1, _AT_ONCE // k)
    for begin in range(0, short.size, step):
        some = short[begin : begin + step]
        rows, size = np.arange(some.size), sizes[some]
        base = np.frombuffer(b"".join([names[i].ljust(64, b"\0") for i in some.tolist()]), np.uint8).reshape(-1, 64)
        message, length = np.repeat(base[None], k, axis=0), np.empty((k, some.size), np.uint32)
        for i in range(k):
            end = f"#{i}".encode() + b"\x80"
            for at, byte in enumerate(end):
                message[i, rows, size + at] = byte
            length[i] = 8 * (size + len(end) - 1)
        block = np.ascontiguousarray(message.reshape(-1, 64).view("<u4").T).astype(np.uint32, copy=False)
        block[14] = length.ravel()
        out[some] = _digests(block).reshape(k, some.size, 2).transpose(1, 0, 2)
    for i in np.setdiff1d(np.arange(len(names)), short).tolist():
        out[i] = [np.frombuffer(md5(names[i] + f"#{j}".encode()).digest()[:8], ">u4") for j in range(k)]
    return out


def index_table(words: list[str], size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Dims and signs of the index vectors of ``words``, for use inside tasks."""
    parts = _numbered_digests([w.encode() for w in words], k).astype(np.int64)
    blocks = np.arange(k)
    edges = np.arange(k + 1) * size // k
    dims = edges[:-1] + parts[:, :, 0] % np.diff(edges)
    signs = 1 - 2 * ((parts[:, blocks // 2, 1] + blocks) % 2)
    return dims, signs


def permute(vec: Column, by: Column | int, size: int) -> Column:
    """Rotate a vector by a signed offset; the cells stay in ascending order."""
    by = F.lit(by) if isinstance(by, int) else by
    cells = F.array_sort(
        F.transform(
            F.arrays_zip(vec["dims"].alias("dims"), vec["vals"].alias("vals")),
            lambda c: F.struct(
                F.pmod(c["dims"] + by, F.lit(size)).cast("int").alias("dim"), c["vals"].alias("val")
            ),
        )
    )
    return F.struct(
        F.transform(cells, lambda c: c["dim"]).alias("dims"),
        F.transform(cells, lambda c: c["val"]).alias("vals"),
    )


def length(vec: Column) -> Column:
    """Euclidean length of a vector."""
    return F.sqrt(F.aggregate(vec["vals"], F.lit(0.0), lambda s, v: s + v * v.cast("double")))


def divide(vec: Column, by: Column) -> Column:
    """Every cell divided by a number."""
    return F.struct(
        vec["dims"].alias("dims"), F.transform(vec["vals"], lambda v: v.cast("double") / by).alias("vals")
    )


def normalize(vec: Column) -> Column:
    """The vector at unit length; the zero vector stays as it is."""
    return divide(vec, length(vec))


def plus(a: Column, b: Column) -> Column:
    """The sum of two vectors, where a missing one counts as zero; evaluated only for rows that have both."""
    both = F.map_zip_with(
        F.map_from_arrays(a["dims"], a["vals"]),
        F.map_from_arrays(b["dims"], b["vals"]),
        lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)),
    )
    cells = F.array_sort(F.map_entries(F.map_filter(both, lambda _, v: v != 0)))
    total = F.struct(F.transform(cells, lambda c: c["key"]).alias("dims"), F.transform(cells, lambda c: c["value"]).alias("vals"))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(total)


def cells(vec: Column) -> Column:
    """Generator of ``(dim, val)`` rows."""
    return F.inline(F.arrays_zip(vec["dims"].alias("dim"), vec["vals"].alias("val")))


def _flat(vecs: pa.StructArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, position key and value of every cell of an Arrow vector column."""
    dims, vals = vecs.field("dims"), vecs.field("vals")
    counts = np.diff(dims.offsets.to_numpy())
    rows = np.repeat(np.arange(len(vecs)), counts)
    values = vals.flatten().to_numpy(zero_copy_only=False)
    return rows, rows * size + dims.flatten().to_numpy(zero_copy_only=False), values.astype(np.float64)


def cosine_function(size: int):
    """``cosine(a, b)`` of two vector columns; NULL where either is missing or zero.

    Spark has no sparse dot product: the built-in way is to explode both sides and
    shuffle by cell. Inside an Arrow batch it is one sorted merge.
    """

    @F.arrow_udf("double")
    def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
        n = len(a)
        rows_a, at_a, val_a = _flat(a, size)
        rows_b, at_b, val_b = _flat(b, size)
        if not len(at_a) or not len(at_b):
            return pa.nulls(n, pa.float64())
        found = np.minimum(np.searchsorted(at_a, at_b), len(at_a) - 1)
        shared = at_a[found] == at_b
        dot = np.bincount(rows_b[shared], val_a[found[shared]] * val_b[shared], minlength=n)
        norm = np.sqrt(
            np.bincount(rows_a, val_a * val_a, minlength=n) * np.bincount(rows_b, val_b * val_b, minlength=n)
        )
        known = norm > 0
        return pa.array(np.divide(dot, norm, where=known, out=np.zeros(n)), mask=~known)

    return cosine
