"""Context vectors of the tokens of a text: summed per word inside a task, or sent as the words they consist of.

The vector of a word that comes seldom has more bytes than the words it is the sum of. So
:func:`deal_contexts` adds up a word where that makes fewer bytes, in as few bits a cell as its sums need, and sends the
contexts of the others as they stand; :func:`add_contexts` adds both up where all rows of a word have met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wordspace.functions.vectors import index_table
from wordspace.operators.partial import WIDE_CODES, PartialVectors, add_encoded, encode, plain_cells, read_cells
from wordspace.space import PACKED_INT, VectorSpace

#: Occurrences of a word in ``SLICE`` tokens from which its sum stays in its task, if the table has room.
OFTEN = 4
#: Tokens looked at together; a longer text is looked at whole.
SLICE = 3 << 20
#: Room for the sums of the sentences looked at together.
WHOLE_BYTES = 96 << 20
#: Cells of contexts that are added up at once.
CONTEXT_CELLS = 1 << 20
#: Cells of sums that are added to at once, so that they stay in the cache.
SUM_CELLS = 1 << 18
#: Rows, and about the bytes, that leave a task together.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1 << 13, 4 << 20
#: Occurrences of a word from which it is added up by itself, and how many of them at once.
MANY, AT_ONCE = 32, 256
#: About the bytes that a token and a row take on their way to the sums.
TOKEN_BYTES, ROW_BYTES = 6, 30

WORDS_REMEMBERED = 200_000
TOKENS_AT_ONCE = 1 << 15


class _IndexVectors:
    """Index vectors of words, remembering those of earlier batches; five bytes a cell."""

    def __init__(self, size: int, k: int):
        self.size, self.k = size, k
        self._forget()

    def _forget(self):
        self.at: dict[str, int] = {}
        self.dims = np.empty((0, self.k), np.int32)
        self.signs = np.empty((0, self.k), np.int8)

    def places(self, words: list[str]) -> np.ndarray:
        """Where the words stand in ``dims`` and ``signs``."""
        if len(self.at) > WORDS_REMEMBERED:
            self._forget()
        unseen = [w for w in words if w not in self.at]
        if unseen:
            dims, signs = index_table(unseen, self.size, self.k)
            self.at.update(zip(unseen, range(len(self.at), len(self.at) + len(unseen))))
            self.dims = np.concatenate((self.dims, dims.astype(np.int32)))
            self.signs = np.concatenate((self.signs, signs.astype(np.int8)))
        return np.fromiter((self.at[w] for w in words), np.int64, len(words))

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dims and signs at the given places, a row each."""
        return self.dims[places].astype(np.int64), self.signs[places].astype(np.int64)


def _add_ordered(table: PartialVectors, index: _IndexVectors, codes, places, whole, lo, hi) -> None:
    """Token ``i`` sees every other token ``j`` turned by ``j - i``.

    ``whole`` is the sum of all tokens ``j`` turned by ``j``, doubled end to end, so the
    context of ``i`` is a slice of it starting at ``i`` less the token itself: linear in
    the sentence where adding up pairs is quadratic.
    """
    size, sums = table.size, table.sums
    rows = table.rows[codes[lo:hi]]
    for i, row in zip(range(lo, hi), rows.tolist()):
        at = i % size
        sums[row] += whole[at : at + size]
    dims, signs = index.of(places[lo:hi])
    np.subtract.at(table.flat, (rows[:, None] * size + dims).ravel(), signs.ravel())


def _whole_sentence(index: _IndexVectors, places) -> np.ndarray:
    total = np.zeros(index.size, np.int64)
    for lo in range(0, len(places), TOKENS_AT_ONCE):
        dims, signs = index.of(places[lo : lo + TOKENS_AT_ONCE])
        turned = (dims + np.arange(lo, lo + len(dims))[:, None]) % index.size
        np.add.at(total, turned.ravel(), signs.ravel())
    return np.concatenate((total, total))


def _add_window(table: PartialVectors, index: _IndexVectors, codes, places, radius, lo, hi) -> None:
    """Token ``i`` sees the tokens at most ``radius`` places away, unturned."""
    for offset in range(-radius, radius + 1):
        first, last = max(lo, -offset), min(hi, len(codes) - offset)
        if offset and first < last:
            dims, signs = index.of(places[first + offset : last + offset])
            rows = table.rows[codes[first:last]]
            np.add.at(table.flat, (rows[:, None] * table.size + dims).ravel(), signs.ravel())


def combine_contexts(space: VectorSpace, ordered: bool):
    """Turn ``(tokens)`` rows into packed partial rows, one per word and task.

    ``weight`` counts the occurrences of the word. Words without any context keep a
    row with an empty vector.
    """
    size, k, radius = space.size, space.k, space.radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PartialVectors(size, np.int64)
        index = _IndexVectors(size, k)
        piece = min(table.capacity // 2, TOKENS_AT_ONCE)
        for batch in batches:
            texts = batch.column("tokens")
            words = texts.values.dictionary_encode()
            all_codes = words.indices.to_numpy()
            all_places = index.places(table.start_batch(words.dictionary))[all_codes]
            edges = texts.offsets.to_numpy().tolist()
            for begin, end in zip(edges, edges[1:]):
                codes, places = all_codes[begin:end], all_places[begin:end]
                whole = _whole_sentence(index, places) if ordered and end > begin else None
                for lo in range(0, len(codes), piece):
                    hi = min(lo + piece, len(codes))
                    yield from table.reserve(codes[lo:hi])
                    np.add.at(table.weights, table.rows[codes[lo:hi]], 1)
                    if ordered:
                        _add_ordered(table, index, codes, places, whole, lo, hi)
                    else:
                        _add_window(table, index, codes, places, radius, lo, hi)
        yield from table.finish()

    return run


DEALT_DDL = (
    f"key string, weight bigint, factor bigint, vec {PACKED_INT}, turn int, tokens string, places array<int>, "
    "code int, head binary, tail binary"
)
_PACKED = pa.struct([("dims", pa.binary()), ("ints", pa.binary())])
_DEALT = pa.schema(
    [
        ("key", pa.string()), ("weight", pa.int64()), ("factor", pa.int64()), ("vec", _PACKED),
        ("turn", pa.int32()), ("tokens", pa.string()), ("places", pa.list_(pa.int32())),
        ("code", pa.int32()), ("head", pa.binary()), ("tail", pa.binary()),
    ]
)


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, as many as its count, end to end."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _slices(batches: Iterator[pa.RecordBatch], tokens: int, room: int, width) -> Iterator[pa.ListArray]:
    """The lists of all batches in runs of about so many elements, that take ``room`` by ``width`` of their lengths."""
    held, most = [], [tokens, room]
    for batch in batches:
        texts = batch.column("tokens")
        edges = texts.offsets.to_numpy().astype(np.int64)
        upto = [edges - edges[0], np.concatenate(([0], np.cumsum(width(np.diff(edges)))))]
        begin = 0
        while begin < len(texts):
            end = min(int(np.searchsorted(u, u[begin] + m, "right")) - 1 for u, m in zip(upto, most))
            end = max(end, begin if held else begin + 1)
            if end > begin:
                held.append(texts.slice(begin, end - begin))
                most = [m - int(u[end] - u[begin]) for u, m in zip(upto, most)]
            if end < len(texts):
                yield pa.concat_arrays(held)
                held, most = [], [tokens, room]
            begin = end
    if held:
        yield pa.concat_arrays(held)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of many small batches in fewer."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _wholes(size: int, k: int, dtype, dims, signs, codes, edges, some) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the given sentences as :func:`_whole_sentence` has them, each followed by as much of itself as its
    tokens need, end to end; and where each begins.
    """
    lengths = np.diff(edges)[some]
    more = np.minimum(lengths, size)
    base = np.cumsum(size + more) - size - more
    flat = np.zeros(int((size + more).sum()), dtype)
    step = max(1, CONTEXT_CELLS // k)
    token, start = _ranges(edges[some], lengths), np.repeat(base, lengths)
    place = _ranges(np.zeros(some.size, np.int64), lengths)
    for lo in range(0, token.size, step):
        word = codes[token[lo : lo + step]]
        at = dims[word] + (place[lo : lo + step] % size)[:, None]
        np.subtract(at, size, out=at, where=at >= size)
        at += start[lo : lo + step][:, None]
        np.add.at(flat, at.ravel(), signs[word].ravel().astype(dtype, copy=False))
    for begin, n in zip(base.tolist(), more.tolist()):
        flat[begin + size : begin + size + n] = flat[begin : begin + n]
    return flat, base


def _vector_bytes(tokens: np.ndarray, space: VectorSpace) -> np.ndarray:
    """About the bytes of the sum of so many index vectors as :func:`encode` has it."""
    full = tokens * space.k / space.size
    return ROW_BYTES + space.size * np.minimum(1.125 * -np.expm1(-full), 0.25 + 0.075 * np.log2(1 + full))


def deal_contexts(space: VectorSpace, ordered: bool):
    """Turn ``(tokens)`` rows into rows keyed by word: sums of contexts of some words, and contexts of the others.

    Sums of words that come often, at most half as many as the table has rows, and of those the table has already are
    kept in the table. Sums of other words go, once for the tokens looked at together, if they take fewer bytes than
    the tokens these words stand among. Else the tokens and the places there go: a sentence, once to each of its words, or
    a window of it. ``turn`` is how far a neighbour is turned per place.
    """
    size, k, radius = space.size, space.k, space.radius

    def encoded(keys, weights, block):
        """Rows of finished sums, a row of ``block`` each."""
        for rows, code, head, tail in encode(block):
            n = rows.size
            columns = [
                keys.take(pa.array(rows)), pa.array(weights[rows]), pa.array(np.ones(n, np.int64)),
                *(pa.nulls(n, field.type) for field in list(_DEALT)[3:7]), pa.array(np.full(n, code, np.int32)), head, tail,
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_DEALT)

    def sent(key, names, codes, first, texts):
        """Rows of the words ``key``; row i has the places that begin at ``first[i]``, and its text."""
        places, edges = first
        n = key.size
        columns = [
            names.take(pa.array(key)), pa.array(np.diff(edges)), pa.array(np.ones(n, np.int64)), pa.nulls(n, _PACKED),
            pa.array(np.full(n, int(ordered), np.int32)), texts,
            pa.ListArray.from_arrays(pa.array((edges - edges[0]).astype(np.int32)), pa.array(places[edges[0] : edges[-1]].astype(np.int32))),
            *(pa.nulls(n, field.type) for field in list(_DEALT)[7:]),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=_DEALT)

    def sentences(lists, names, codes, edges, sentence, light):
        token = np.flatnonzero(light)
        token = token[np.lexsort((token, codes[token], sentence[token]))]
        both = sentence[token] * np.int64(len(names)) + codes[token]
        first = np.flatnonzero(np.diff(both, prepend=-1))
        # A word that its sentence repeats has several rows if its contexts are many.
        nth = np.arange(token.size) - np.repeat(first, np.diff(np.append(first, token.size)))
        most = np.maximum(1, CONTEXT_CELLS // (k * np.diff(edges)))[sentence[token]]
        first = np.flatnonzero(nth % most == 0)
        places, stops = token - edges[sentence[token]], np.append(first, token.size)
        for lo in range(0, first.size, 1 << 14):
            own = stops[lo : lo + (1 << 14) + 1]
            at = token[own[:-1]]
            which, text = np.unique(sentence[at], return_inverse=True)
            joined = pc.binary_join(lists.take(pa.array(which)).cast(pa.list_(pa.string())), " ")
            yield sent(codes[at], names, codes, (places, own), joined.take(pa.array(text)))

    def windows(lists, names, codes, edges, sentence, light):
        token = np.flatnonzero(light)
        for lo in range(0, token.size, 1 << 14):
            at = token[lo : lo + (1 << 14)]
            begin = np.maximum(at - radius, edges[sentence[at]])
            counts = np.minimum(at + radius + 1, edges[sentence[at] + 1]) - begin
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            texts = pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(pa.array(codes[_ranges(begin, counts)]))), " ")
            yield sent(codes[at], names, codes, (at - begin, np.arange(at.size + 1)), texts)

    def adder(flat, start, dims, signs):
        """``add(sums, words, first, counts)``: add the contexts that begin at ``start`` to the sums of their words."""
        view = np.lib.stride_tricks.as_strided(flat, (flat.size - size + 1, size), (flat.itemsize, flat.itemsize))
        kind = np.int16 if flat.itemsize == 1 else np.int64

        def add(sums, words, first, counts):
            for i in np.flatnonzero(counts > MANY).tolist():
                for lo in range(first[i], first[i] + counts[i], AT_ONCE):
                    sums[i] += view[start[lo : min(lo + AT_ONCE, first[i] + counts[i])]].astype(kind).sum(0, dtype=kind)
            few = np.flatnonzero(counts <= MANY)
            for nth in range(counts[few].max(initial=0)):
                rows = few[counts[few] > nth]
                # Words come by their counts, so that these are neighbours.
                sums[rows[0] : rows[-1] + 1] += view[start[first[rows] + nth]].astype(sums.dtype)
            # Every context has the token itself, unturned.
            at = np.arange(words.size)[:, None] * size + dims[words]
            sums.reshape(-1)[at] -= signs[words] * counts[:, None].astype(sums.dtype)

        return add

    def sentence_sums(dims, signs, codes, edges, sentence, here):
        """Of sentences with tokens to add up, ``(tokens, add)`` of each part; a part's sums fit the room for them."""
        added = np.unique(sentence[here])
        lengths = np.diff(edges)[added]
        # A cell of a sentence's sum is at most its tokens. Seldom is it more than a byte.
        wide = np.zeros(added.size, bool)
        for i in np.flatnonzero(lengths > 127).tolist():
            flat, _ = _wholes(size, k, np.int64, dims, signs, codes, edges, added[i : i + 1])
            wide[i] = np.abs(flat).max() > 127
        parts = [(added[~wide], np.int8)] if not wide.all() else []
        most = max(1, WHOLE_BYTES // (16 * size))
        others = added[wide]
        parts += [(others[lo : lo + most], np.int64) for lo in range(0, others.size, most)]
        for some, dtype in parts:
            flat, base = _wholes(size, k, dtype, dims, signs, codes, edges, some)
            begins = np.full(edges.size - 1, -1)
            begins[some] = base
            token = np.flatnonzero(here & (begins[sentence] >= 0))
            # Sorted by word, so that a word's tokens stand together.
            token = token[np.argsort(codes[token], kind="stable")]
            yield codes[token], adder(flat, begins[sentence[token]] + (token - edges[sentence[token]]) % size, dims, signs)

    def window_sums(dims, signs, codes, edges, sentence, here):
        token = np.flatnonzero(here)
        token = token[np.argsort(codes[token], kind="stable")]

        def add(sums, words, first, counts):
            flat, step = sums.reshape(-1), max(1, CONTEXT_CELLS // (2 * k))
            row, at = np.repeat(np.arange(words.size), counts), token[_ranges(first, counts)]
            for lo in range(0, at.size, step):
                own, rows = at[lo : lo + step], row[lo : lo + step]
                of = sentence[own]
                for offset in range(-radius, radius + 1):
                    if offset:
                        inside = np.flatnonzero((own + offset >= edges[of]) & (own + offset < edges[of + 1]))
                        word = codes[own[inside] + offset]
                        np.add.at(flat, (rows[inside][:, None] * size + dims[word]).ravel(), signs[word].ravel().astype(flat.dtype))

        if token.size:
            yield codes[token], add

    def added_up(table, index, names, codes, edges, sentence, here, often):
        """Sums of the words of the tokens ``here``: into the table, or as rows."""
        if not here.any():
            return
        if ordered:
            near = np.isin(sentence, np.unique(sentence[here]))
        else:
            token, near = np.flatnonzero(here), np.zeros(codes.size + 1, np.int64)
            np.add.at(near, np.maximum(token - radius, edges[sentence[token]]), 1)
            np.add.at(near, np.minimum(token + radius + 1, edges[sentence[token] + 1]), -1)
            near = np.cumsum(near)[:-1] > 0
        used = np.unique(codes[near])
        places = index.places(names.take(pa.array(used)).to_pylist())
        dims, signs = np.zeros((len(names), k), np.int32), np.zeros((len(names), k), np.int8)
        dims[used], signs[used] = index.dims[places], index.signs[places]
        step = max(1, min(SUM_CELLS // size, table.capacity // 2))
        kind = np.int32 if codes.size < 1 << 24 else np.int64
        for own, add in (sentence_sums if ordered else window_sums)(dims, signs, codes, edges, sentence, here):
            first = np.flatnonzero(np.diff(own, prepend=-1))
            counts = np.diff(np.append(first, own.size))
            most = np.argsort(-counts, kind="stable")
            for lo in range(0, most.size, step):
                some = most[lo : lo + step]
                words = own[first[some]]
                sums = np.zeros((some.size, size), kind)
                add(sums, words, first[some], counts[some])
                kept = often[words]
                if kept.any():
                    for key, weight, block in table.reserve(words[kept], table.sums_of):
                        yield from encoded(key, weight, block)
                    rows = table.rows[words[kept]]
                    table.sums[rows] += sums[kept]
                    table.weights[rows] += counts[some][kept]
                if not kept.all():
                    gone = slice(None) if not kept.any() else ~kept
                    yield from encoded(names.take(pa.array(words[gone])), counts[some][gone], sums[gone])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PartialVectors(size, np.int64)
        index = _IndexVectors(size, k)
        width = (lambda lengths: size + np.minimum(lengths, size)) if ordered else np.zeros_like
        for lists in _slices(batches, SLICE, WHOLE_BYTES, width):
            words = lists.flatten().dictionary_encode()
            names, codes = words.dictionary.cast(pa.string()), words.indices.to_numpy()
            if not codes.size:
                continue
            edges = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int64)
            sentence = np.repeat(np.arange(len(lists)), np.diff(edges))
            table.start_batch(names)
            counts = np.bincount(codes, minlength=len(names))
            most = np.argsort(-counts, kind="stable")[: table.capacity // 2]
            often = table.rows >= 0
            often[most[counts[most] >= OFTEN]] = True
            near = np.diff(edges)[sentence] if ordered else np.full(codes.size, 2 * radius + 1)
            tokens = np.bincount(codes, near, len(names))
            summed = often | (ROW_BYTES * counts + TOKEN_BYTES * tokens > _vector_bytes(tokens - counts, space))
            here = summed[codes]
            shape = (names, codes, edges, sentence)
            yield from (sentences if ordered else windows)(lists, *shape, ~here)
            yield from added_up(table, index, *shape, here, often)
        for key, weight, block in table.finish(table.sums_of):
            yield from encoded(key, weight, block)

    return lambda batches: _joined(run(batches))


def add_contexts(space: VectorSpace):
    """``(key, weight, vec)`` from the rows of :func:`deal_contexts`, sorted by key: one row per word.

    Contexts are turned into cells and added up a bounded number at a time; what is held beyond that is the sum of the
    word in progress.
    """
    size, k = space.size, space.k

    def read_tokens(index, batch):
        """Of the rows with tokens: which they are, where their tokens begin, their index vectors, and their places."""
        here = batch.column("tokens").is_valid()
        some = batch.filter(here)
        texts, lists = pc.split_pattern(some.column("tokens"), " "), some.column("places")
        words = texts.flatten().dictionary_encode()
        vectors = index.places(words.dictionary.to_pylist())[words.indices.to_numpy()]
        turned = bool(some.num_rows and some.column("turn")[0].as_py())
        at = np.flatnonzero(here.to_numpy(zero_copy_only=False))
        return at, texts.offsets.to_numpy().astype(np.int64), vectors, lists.offsets.to_numpy(), lists.values.to_numpy(), turned

    def add_tokens(sums, index, code, contexts, lo, hi):
        """Add the contexts of the rows from ``lo`` to ``hi`` to the sums of their words, ``code`` by row."""
        at, edges, vectors, offsets, places, turned = contexts
        first, last = np.searchsorted(at, (lo, hi))
        if first == last:
            return
        row = np.repeat(np.arange(first, last), np.diff(offsets[first : last + 1]))
        length = edges[row + 1] - edges[row]
        far = _ranges(np.zeros(row.size, np.int64), length) - np.repeat(places[offsets[first] : offsets[last]], length)
        other = np.flatnonzero(far)
        token, far = _ranges(edges[row], length)[other], far[other]
        begin = np.repeat(code[at[row] - lo], length)[other]
        room = 0
        if turned:
            # Turned by less than half the size either way, past the ends of a row that is as much longer.
            far = (far + size // 2) % size - size // 2
            room = int(np.abs(far).max(initial=0))
        wide = sums if not room else np.zeros((len(sums), size + 2 * room), sums.dtype)
        begin = begin * wide.shape[1] + (far + room if room else 0)
        vector = vectors[token]
        step = max(1, CONTEXT_CELLS // k)
        for i in range(0, vector.size, step):
            part = vector[i : i + step]
            cells = index.dims.take(part, axis=0) + begin[i : i + step, None]
            np.add.at(wide.reshape(-1), cells.ravel(), index.signs.take(part, axis=0).ravel().astype(wide.dtype))
        if room:
            sums += wide[:, room : room + size]
            sums[:, :room] += wide[:, room + size :]
            sums[:, size - room :] += wide[:, :room]

    def rows(keys, weights, sums):
        at = np.flatnonzero(sums != 0)
        edges = np.searchsorted(at, np.arange(len(keys) + 1) * size)
        dims = at - np.repeat(np.arange(len(keys)) * size, np.diff(edges))
        vecs = plain_cells(edges, dims, sums.reshape(-1)[at].astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(weights), vecs], ["key", "weight", "vec"])

    def add(index, batch, contexts, lo, vec, held):
        """The finished rows of a part of a batch, from row ``lo`` on, and the word in progress: its key, weight and sums."""
        names = batch.column("key").dictionary_encode("encode")
        keys, code = names.dictionary.to_pylist(), names.indices.to_numpy().astype(np.int64)
        if held is not None and held[0] != keys[0]:
            keys, code = [held[0], *keys], code + 1
        weights = np.zeros(len(keys), np.int64)
        np.add.at(weights, code, batch.column("weight").to_numpy())
        coded = batch.column("code").is_valid()
        some = batch.filter(coded)
        edges, dims, vals = vec
        # Contexts and the rows of two bytes a cell at most are too few to add up to more than four bytes.
        small = edges[-1] == edges[0] and not np.isin(some.column("code").to_numpy(), WIDE_CODES).any()
        small = small and (held is None or np.abs(held[2]).max(initial=0) < 1 << 30) and batch.num_rows <= 1 << 14
        sums = np.zeros((len(keys), size), np.int32 if small else np.int64)
        if held is not None:
            weights[0] += held[1]
            sums[0] = held[2]
        add_tokens(sums, index, code, contexts, lo, lo + batch.num_rows)
        if some.num_rows:
            add_encoded(sums, code[coded.to_numpy(zero_copy_only=False)], *(some.column(c) for c in ("code", "head", "tail")))
        if edges[-1] > edges[0]:
            counts = np.diff(edges)
            own = np.repeat(code * size, counts) + dims[edges[0] : edges[-1]].astype(np.int64)
            times = np.repeat(batch.column("factor").to_numpy(), counts)
            np.add.at(sums.reshape(-1), own, vals[edges[0] : edges[-1]].astype(np.int64) * times)
        return rows(keys[:-1], weights[:-1], sums[:-1]), (keys[-1], weights[-1], sums[-1].astype(np.int64))

    def cuts(costs, most):
        """Where rows of the given costs are cut so that those between have about so much."""
        upto, begin = np.cumsum(costs), 0
        while begin < upto.size:
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + most, "right")))
            yield begin, end
            begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _IndexVectors(size, k)
        held = None
        for batch in batches:
            edges, dims, vals = read_cells(batch.column("vec"))
            length = pc.fill_null(pc.add(pc.count_substring(batch.column("tokens"), " "), 1), 0).to_numpy().astype(np.int64)
            many = pc.fill_null(pc.list_value_length(batch.column("places")), 0).to_numpy()
            # A word has sums however few its cells are.
            cells = np.maximum(length * many * k + np.diff(edges), size)
            for begin, end in cuts(length, SUM_CELLS):
                part = batch.slice(begin, end - begin)
                contexts = read_tokens(index, part)
                for lo, hi in cuts(cells[begin:end], CONTEXT_CELLS):
                    vec = (edges[begin + lo : begin + hi + 1], dims, vals)
                    done, held = add(index, part.slice(lo, hi - lo), contexts, lo, vec, held)
                    if done.num_rows:
                        yield done
        if held is not None:
            yield rows([held[0]], np.array([held[1]]), held[2][None])

    return run
