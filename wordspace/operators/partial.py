"""Map-side combining of sparse vectors inside a task.

Spark has no aggregate that adds arrays cell by cell. Exploding every contribution
into ``(key, dim, val)`` rows first costs thousands of rows per token, so the adding
is done where the contribution arises: each task keeps a bounded table of partial
vectors and hands on one row per key. Grouping keys across tasks stays with Spark.

Between such steps vectors travel packed, as one blob of dims and one of values: four
bytes a cell instead of twelve, and Spark copies a blob whole where it converts an array
element by element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

TABLE_BYTES = 128 << 20
OUTPUT_CELLS = 1 << 20


def read_cells(vecs: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row edges, dims and values of a vector column, plain or packed, without copying."""
    first, second = vecs.field(0), vecs.field(1)
    if pa.types.is_list(first.type):
        return first.offsets.to_numpy(), first.values.to_numpy(), second.values.to_numpy()
    kind = np.dtype(np.float64 if vecs.type.field(1).name == "reals" else np.int16)
    edges = np.frombuffer(second.buffers()[1], np.int32, len(vecs) + 1) // kind.itemsize
    if not edges[-1]:
        return edges, np.empty(0, np.uint16), np.empty(0, kind)
    wide = np.frombuffer(first.buffers()[1], np.int32, len(vecs) + 1)[-1] == 4 * edges[-1]
    dims = np.frombuffer(first.buffers()[2], np.int32 if wide else np.uint16, edges[-1])
    return edges, dims, np.frombuffer(second.buffers()[2], kind, edges[-1])


def plain_cells(edges: np.ndarray, dims: np.ndarray, vals: np.ndarray) -> pa.StructArray:
    """The vector column of the given row edges and cells."""
    offsets = pa.array(edges.astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(part)) for part in (dims.astype(np.int32), vals)]
    return pa.StructArray.from_arrays(lists, ["dims", "vals"])


def packed_cells(edges: np.ndarray, dims: np.ndarray, vals: np.ndarray, size: int) -> pa.StructArray:
    """The packed vector column: two bytes a dim below 65536, two a whole number."""

    def blob(part: np.ndarray) -> pa.Array:
        offsets = pa.py_buffer((edges * part.itemsize).astype(np.int32))
        data = pa.py_buffer(np.ascontiguousarray(part))
        return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, offsets, data])

    dims = dims.astype(np.uint16 if size <= 1 << 16 else np.int32)
    return pa.StructArray.from_arrays([blob(dims), blob(vals)], ["dims", "reals" if vals.dtype.kind == "f" else "ints"])


def digits(edges: np.ndarray, dims: np.ndarray, vals: np.ndarray) -> Iterator[tuple]:
    """``(rows, times, edges, dims, vals)``: vectors whose sum, each counted ``times``, is the input.

    Nearly all partial sums fit two bytes. One that does not goes on as several rows, each
    holding 15 bits of it; real vectors go on as they are.
    """
    rows, times = np.arange(len(edges) - 1), 1
    if vals.dtype.kind == "f":
        yield rows, times, edges, dims, vals
        return
    if not len(vals) or -0x8000 <= vals.min() and vals.max() < 0x8000:
        yield rows, times, edges, dims, vals.astype(np.int16)
        return

    def only(kept: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(kept)))[edges]

    while True:
        low = ((vals + 0x4000) & 0x7FFF) - 0x4000
        kept = low != 0
        yield rows, times, only(kept, edges), dims[kept], low[kept].astype(np.int16)
        vals = (vals - low) >> 15
        kept = vals != 0
        if not kept.any():
            return
        edges, dims, vals, times = only(kept, edges), dims[kept], vals[kept], times << 15
        some = np.diff(edges) > 0
        rows, edges = rows[some], np.concatenate((edges[:-1][some], edges[-1:]))


def pack_rows(size: int):
    """Pack the ``vec`` column, the last one, of rows whose last but one is ``factor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, dims, vals = read_cells(batch.column("vec"))
            for rows, times, *cells in digits(edges, dims[: edges[-1]], vals[: edges[-1]]):
                columns = {name: batch.column(name).take(pa.array(rows)) for name in batch.schema.names[:-1]}
                columns["factor"] = pa.array(columns["factor"].to_numpy() * times)
                if times > 1 and "weight" in columns:
                    columns["weight"] = pa.array(np.zeros(len(rows), np.int64))
                arrays = [*columns.values(), packed_cells(*cells, size)]
                yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return run


#: How a vector is encoded. Below ``DENSE``: bytes of a gap, and how its values are, by signs alone, in a byte or in eight.
#: From it on: bits of a place; a place of two or four bits may say that its value stands behind the others.
SPARSE = [(gap, value) for gap in (1, 4) for value in (0, 1, 8)]
DENSE = len(SPARSE)
BITS = [2, 4, 8, 16, 64]
#: Codes of numbers of more than two bytes.
WIDE_CODES = (*(i for i, (_, value) in enumerate(SPARSE) if value == 8), DENSE + len(BITS) - 1)


def _blobs(counts: np.ndarray, data: np.ndarray) -> pa.Array:
    """The array of binaries of the given lengths, from their bytes end to end."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _blob_bytes(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where binaries begin, and their bytes end to end."""
    edges = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    data = blobs.buffers()[2]
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None and edges[-1] > edges[0] else np.empty(0, np.uint8)
    return edges - edges[0], data


def _packed(counts: np.ndarray, parts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of so few bits, as many of each row as ``counts`` says, packed; the bytes of each row."""
    per = 8 // bits
    sizes = -(-counts // per)
    room = np.zeros(int(sizes.sum()) * per, np.uint8)
    begin = np.repeat((np.cumsum(sizes) - sizes) * per - (np.cumsum(counts) - counts), counts)
    room[begin + np.arange(parts.size)] = parts
    room = room.reshape(-1, per)
    out = room[:, 0].copy()
    for i in range(1, per):
        out |= room[:, i] << np.uint8(i * bits)
    return sizes, out


def _unpacked(counts: np.ndarray, data: np.ndarray, bits: int) -> np.ndarray:
    """The numbers of :func:`_packed`."""
    per = 8 // bits
    sizes = -(-counts // per)
    begin = np.repeat((np.cumsum(sizes) - sizes) * per - (np.cumsum(counts) - counts), counts)
    room = (data[:, None] >> (np.arange(per, dtype=np.uint8) * np.uint8(bits))) & np.uint8((1 << bits) - 1)
    return room.reshape(-1)[begin + np.arange(begin.size)]


def encode(block: np.ndarray) -> Iterator[tuple[np.ndarray, int, pa.Array, pa.Array]]:
    """``(rows, code, head, tail)``: the rows of a block of whole numbers in few bytes, those of the same code together."""
    size = block.shape[1]
    most = np.maximum(block.max(1), -block.min(1).astype(np.int64))
    # Counted and joined eight places at once, so that there are some places more, all 0.
    narrow = np.zeros((len(block), -(-size // 8) * 8), np.int8)
    np.clip(block, -127, 127, out=narrow[:, :size], casting="unsafe")
    high = np.abs(narrow)

    def count(found):
        return np.bitwise_count(found.view(np.uint64)).sum(1, dtype=np.int64)

    cells, over = count(narrow != 0), [count(high > 1), count(high > 7)]
    costs = np.full((DENSE + len(BITS), len(block)), np.inf)
    for i, (limit, cost) in enumerate(
        ((9, size / 4 + over[0] / 2), (127, size / 2 + over[1]), (127, size), (0x7FFF, 2 * size), (np.inf, 8 * size))
    ):
        costs[DENSE + i] = np.where(most <= limit, cost, np.inf)
    best = costs.min(0)
    thin = np.flatnonzero(9 * cells < 8 * best)
    at = np.flatnonzero(block[thin] != 0)
    row = np.repeat(np.arange(thin.size), cells[thin])
    place = at - row * size
    gaps = np.diff(place, prepend=-1)
    first = np.cumsum(cells[thin]) - cells[thin]
    started = first[cells[thin] > 0]
    gaps[started] = place[started] + 1
    gaps -= 1
    vals = block[thin].reshape(-1)[at]
    longest = np.zeros(thin.size, np.int64)
    np.maximum.at(longest, row, gaps)
    for i, (gap, value) in enumerate(SPARSE):
        fits = (longest < 256 if gap == 1 else True) & (most[thin] <= {0: 1, 1: 127, 8: np.inf}[value])
        costs[i, thin] = np.where(fits, cells[thin] * (gap + (value or 0.125)), np.inf)
    codes = np.argmin(costs, axis=0)
    for code in np.unique(codes).tolist():
        rows = np.flatnonzero(codes == code)
        if code < DENSE:
            gap, value = SPARSE[code]
            own = (codes == code)[thin][row]
            n = cells[rows]
            head = _blobs(n * gap, gaps[own].astype(np.uint8 if gap == 1 else np.uint32).view(np.uint8))
            if value:
                tail = _blobs(n * value, vals[own].astype(np.int8 if value == 1 else np.int64).view(np.uint8))
            else:
                tail = _blobs(*_packed(n, (vals[own] < 0).astype(np.uint8), 1))
            yield rows, code, head, tail
            continue
        bits = BITS[code - DENSE]
        if bits >= 8:
            whole = block[rows].astype(f"i{bits // 8}")
            yield rows, code, _blobs(np.full(rows.size, size * bits // 8), whole.reshape(-1).view(np.uint8)), _blobs(np.zeros(rows.size), np.empty(0, np.uint8))
            continue
        # Places are dealt to as many stretches as a byte has room for, a byte has one of each.
        limit, shift = (1, 1) if bits == 2 else (7, 3)
        own = narrow[rows]
        far = high[rows] > limit
        said = own.view(np.uint8) & np.uint8((1 << bits) - 1)
        said &= far.view(np.uint8) - np.uint8(1)
        said |= far.view(np.uint8) << np.uint8(shift)
        said = said.reshape(rows.size, 8 // bits, -1)
        head = said[:, 0].copy()
        for i in range(1, 8 // bits):
            head |= said[:, i] << np.uint8(i * bits)
        counts, left = over[0 if bits == 2 else 1][rows], own.reshape(-1)[np.flatnonzero(far)]
        if bits == 2:
            tail = _blobs(*_packed(counts, (np.abs(left) - 2).astype(np.uint8) | (left < 0).astype(np.uint8) << 3, 4))
        else:
            tail = _blobs(counts, left.view(np.uint8))
        yield rows, code, _blobs(np.full(rows.size, head.shape[1]), head.reshape(-1)), tail


def add_encoded(sums: np.ndarray, at: np.ndarray, codes: pa.Array, heads: pa.Array, tails: pa.Array) -> None:
    """Add encoded vectors to the rows ``at`` of ``sums``, of which equal ones stand together."""
    size, flat = sums.shape[1], sums.reshape(-1)
    codes = codes.to_numpy()
    for code in np.unique(codes).tolist():
        own = np.flatnonzero(codes == code)
        rows = at[own]
        begin, head = _blob_bytes(heads.take(pa.array(own)))
        end, tail = _blob_bytes(tails.take(pa.array(own)))
        if code < DENSE:
            gap, value = SPARSE[code]
            n = np.diff(begin) // gap
            steps = np.cumsum(head.view(np.uint8 if gap == 1 else np.uint32).astype(np.int64) + 1)
            before = np.concatenate(([0], steps))[begin[:-1] // gap]
            if value:
                vals = tail.view(np.int8 if value == 1 else np.int64).astype(np.int64)
            else:
                vals = 1 - 2 * _unpacked(n, tail, 1).astype(np.int64)
            np.add.at(flat, np.repeat(rows * size - before - 1, n) + steps, vals)
            continue
        bits = BITS[code - DENSE]
        if bits >= 8:
            block = head.view(f"i{bits // 8}").reshape(rows.size, size)
        else:
            per = 8 // bits
            limit, beyond = (1, 2) if bits == 2 else (7, 8)
            head = head.reshape(rows.size, -1)
            block = np.concatenate([(head >> np.uint8(i * bits)) & np.uint8((1 << bits) - 1) for i in range(per)], axis=1)[:, :size]
            far = np.flatnonzero(block == beyond)
            # The upper half of the numbers are those below 0.
            block = (block ^ np.uint8(beyond)).view(np.int8) - np.int8(beyond)
            if bits == 2:
                left = _unpacked(np.bincount(far // size, minlength=rows.size), tail, 4).view(np.int8)
                left = ((left & 7) + 2) * (1 - 2 * (left >> 3))
            else:
                left = tail.view(np.int8)
            block.reshape(-1)[far] = left
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        nth = np.arange(rows.size) - np.repeat(first, np.diff(np.append(first, rows.size)))
        for i in range(nth.max(initial=-1) + 1):
            some = np.flatnonzero(nth == i)
            sums[rows[some]] += block[some]


class PartialVectors:
    """Dense partial sums for a bounded number of keys.

    Keys that do not fit push others out: by default the least used, so a frequent
    key leaves a task once however often it occurs; with ``ordered`` input all but the
    key in progress, so every key leaves exactly once.
    """

    def __init__(self, size: int, dtype, ordered: bool = False, centre: np.ndarray | None = None):
        self.size, self.ordered, self.centre = size, ordered, centre
        self.capacity = max(16, TABLE_BYTES // (8 * size))
        self.sums = np.zeros((self.capacity, size), dtype)
        self.flat = self.sums.reshape(-1)
        self.weights = np.zeros(self.capacity, np.int64)
        self.keys: list = [None] * self.capacity
        self.row_of: dict = {}
        self.free = list(range(self.capacity - 1, -1, -1))

    def start_batch(self, keys: pa.Array) -> list:
        """Take the distinct keys the following calls refer to by number; returns them."""
        self.key_type = keys.type
        self.batch_keys = keys.to_pylist()
        self.rows = np.array([self.row_of.get(key, -1) for key in self.batch_keys], np.int64)
        return self.batch_keys

    def reserve(self, codes: np.ndarray, how=None) -> Iterator:
        """Give each of the keys a row, yielding the rows pushed out for it, as batches or as ``how`` has them."""
        fresh = codes[self.rows[codes] < 0]
        if not len(fresh):
            return
        fresh = np.unique(fresh)
        if len(fresh) > len(self.free):
            used = np.fromiter(self.row_of.values(), np.int64, len(self.row_of))
            if self.ordered:
                out = used[used != self.last_row]
            else:
                # The keys now asked for stay, and of the others the most used.
                asked = self.rows[codes]
                used = np.setdiff1d(used, asked[asked >= 0])
                out = used[np.argsort(-self.weights[used], kind="stable")[self.capacity // 4 :]]
                if len(self.free) + len(out) < len(fresh):
                    out = used
            yield from self.release(out, how)
        for code in fresh.tolist():
            row = self.free.pop()
            self.rows[code] = row
            self.keys[row] = self.batch_keys[code]
            self.row_of[self.batch_keys[code]] = row
        self.last_row = self.rows[codes[-1]]

    def release(self, rows: np.ndarray, how=None) -> Iterator:
        """Yield the given rows and make room for others: ``(key, weight, vec)`` with plain
        vectors if they are finished, ``(key, weight, factor, vec)`` with packed ones if not.
        """
        step = max(1, OUTPUT_CELLS // self.size)
        for at in range(0, len(rows), step):
            yield from (how or self._batches)(rows[at : at + step])
        self.sums[rows] = 0
        self.weights[rows] = 0
        for row in rows.tolist():
            del self.row_of[self.keys[row]]
        self.free.extend(rows.tolist())
        self.rows[np.isin(self.rows, rows)] = -1

    def finish(self, how=None) -> Iterator:
        if self.row_of:
            yield from self.release(np.fromiter(self.row_of.values(), np.int64, len(self.row_of)), how)

    def sums_of(self, rows: np.ndarray) -> Iterator[tuple]:
        """Keys, weights and sums of the given rows."""
        yield pa.array([self.keys[r] for r in rows.tolist()], self.key_type), self.weights[rows], self.sums[rows]

    def _batches(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = self.sums[rows]
        if self.centre is not None:
            block -= self.weights[rows][:, None] * self.centre
        block = block.reshape(-1)
        at = np.flatnonzero(block != 0)
        cells = np.searchsorted(at, np.arange(len(rows) + 1) * self.size), at % self.size, block[at]
        keys = pa.array([self.keys[r] for r in rows.tolist()], self.key_type)
        weights = self.weights[rows]
        if self.ordered:
            columns = [keys, pa.array(weights), plain_cells(*cells)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "weight", "vec"])
            return
        for some, times, *part in digits(*cells):
            counted = weights[some] if times == 1 else np.zeros(len(some), np.int64)
            factor = pa.array(np.full(len(some), times, block.dtype))
            columns = [keys.take(pa.array(some)), pa.array(counted), factor, packed_cells(*part, self.size)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "weight", "factor", "vec"])


def _alone(batch: pa.RecordBatch, dtype) -> tuple[pa.RecordBatch | None, pa.RecordBatch]:
    """The finished rows of keys that have one row in sorted input, and the rows of the others.

    The first and the last row of a batch may go on in another.
    """
    codes = batch.column("key").dictionary_encode("encode").indices.to_numpy()
    alone = np.zeros(codes.size, bool)
    alone[1:-1] = (codes[1:-1] != codes[:-2]) & (codes[1:-1] != codes[2:])
    if not alone.any():
        return None, batch
    edges, dims, vals = read_cells(batch.column("vec"))
    counts = np.diff(edges)
    cells = slice(edges[0], edges[-1])
    vals = vals[cells].astype(dtype) * np.repeat(batch.column("factor").to_numpy(), counts)
    kept = np.repeat(alone, counts) & (vals != 0)
    upto = np.concatenate(([0], np.cumsum(kept)))[edges - edges[0]]
    own = np.concatenate(([0], np.cumsum(np.diff(upto)[alone])))
    some = pa.array(alone)
    columns = [batch.column("key").filter(some), batch.column("weight").filter(some), plain_cells(own, dims[cells][kept], vals[kept])]
    return pa.RecordBatch.from_arrays(columns, ["key", "weight", "vec"]), batch.filter(pa.array(~alone))


def add_rows(size: int, dtype, ordered: bool = False, centre: np.ndarray | None = None, unit: bool = False):
    """Sum ``(key, weight, factor, vec)`` rows by key, finishing the keys of ``ordered`` input.

    With ``unit`` every incoming vector is brought to unit length first; zero vectors
    stay zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PartialVectors(size, dtype, ordered, centre)
        for batch in batches:
            if ordered and centre is None and not unit:
                done, batch = _alone(batch, dtype)
                if done is not None:
                    yield done
            keys = batch.column("key").dictionary_encode("encode")
            codes = keys.indices.to_numpy()
            table.start_batch(keys.dictionary)
            weight = batch.column("weight").to_numpy()
            factor = batch.column("factor").to_numpy()
            edges, dim, val = read_cells(batch.column("vec"))
            step = table.capacity // 2
            for lo in range(0, len(codes), step):
                hi = min(lo + step, len(codes))
                yield from table.reserve(codes[lo:hi])
                rows = table.rows[codes[lo:hi]]
                np.add.at(table.weights, rows, weight[lo:hi])
                counts = np.diff(edges[lo : hi + 1])
                cells = slice(edges[lo], edges[hi])
                at = np.repeat(rows * size, counts) + dim[cells].astype(np.int64)
                values, times = val[cells].astype(dtype, copy=False), factor[lo:hi]
                if unit:
                    squares = np.bincount(np.repeat(np.arange(hi - lo), counts), values * values, minlength=hi - lo)
                    times = times / np.sqrt(np.where(squares > 0, squares, 1.0))
                if (times != 1).any():
                    values = values * np.repeat(times, counts)
                np.add.at(table.flat, at, values)
        yield from table.finish()

    return run
