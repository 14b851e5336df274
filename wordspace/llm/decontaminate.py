"""Benchmark items quoted in texts, exactly or with a bounded number of edits.

Texts and items are compared as normalised characters: A-Z lower-cased, every run of
characters other than letters and digits one space. An item of m characters has a budget
of k = m / 10 edits. By the q-gram lemma a quotation within the budget shares at least
m - q + 1 - k q of the item's q-grams with the item, on diagonals at most k apart. So
shared q-grams are counted in bands of 2 (k + 1) diagonals that overlap by half, bands that
reach the bound are kept, and a banded alignment of item and text decides.

A passage of an item is found too: short windows stand so dense in longer items that every
passage of ``PASSAGE`` characters holds one. They are searched for where shared q-grams, all
windows taken together, are as many in a band as one of them needs.

Equal items, and equal windows of items, are searched for once. A q-gram with more than ``COMMON`` places in
a block of items, as repetition makes, has no votes; a window needs fewer votes by as many of
its q-grams as are such, so nothing is lost. A window that would need none is looked for wherever a
stretch of text has enough of its q-grams in any order. Votes are counted as the text goes by, so memory does
not grow with how often text and items repeat themselves.

Characters beyond ASCII count as their UTF-8 bytes. Texts never move: the items, in blocks
of bounded size, go to the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordspace.llm.words import pieces, text_bytes
from wordspace.sources.scratch import materialize

Q = 8
#: Edits allowed, as a share of the characters of an item.
EDITS = 0.1
#: Longer items are searched by windows of this many characters, begun every half of it.
WINDOW = 800
#: Windows for passages of an item, and how far apart they begin; shorter items have none.
SHORT, STRIDE = 256, 16
#: Characters from which any passage of an item holds a short window.
PASSAGE = SHORT + STRIDE - 1
#: Bytes of items that are broadcast at once; more of them are searched block by block.
BLOCK_BYTES = 4 << 20
#: Longer items are cut to overlapping parts of this many characters.
SEGMENT = 400_000
#: Places from which a q-gram of a block of items has no votes.
COMMON = 64
#: Shared q-grams, places counted, that are looked at together, and counted in one go.
TOGETHER, SLICE = 1 << 20, 1 << 17
#: Characters of a text searched at once; longer texts are searched in overlapping parts.
PART = 1 << 20

_CLASS = np.full(256, 32, np.uint8)
_CLASS[48:58], _CLASS[97:123], _CLASS[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_CLASS[65:91] = np.arange(97, 123)
_TABLE_BITS = 22
#: Bits of a band's number: the part of a text above, the window, and the cell of its diagonal.
_WINDOW_BITS, _CELL_BITS = 22, 22
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def normalise(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of texts laid end to end, and their offsets."""
    raw = _CLASS[raw]
    keep = raw != 32
    if keep.size:
        keep[1:] |= keep[:-1]
        keep[offsets[:-1][np.diff(offsets) > 0]] |= raw[offsets[:-1][np.diff(offsets) > 0]] != 32
    places = np.concatenate(([0], np.cumsum(keep)))
    return raw[keep], places[offsets]


def grams(data: np.ndarray) -> np.ndarray:
    """All runs of eight bytes as integers."""
    size = max(0, data.size - Q + 1)
    return np.ndarray(size, "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64) if size else np.empty(0, np.uint64)


@dataclass
class Items:
    """A block of items ready to be searched for, by windows of their ``data``.

    The first ``whole`` windows are those of whole items and of ``WINDOW`` characters, the
    others the short ones; either are in the order of their places. ``owner`` is the one item that
    has a window, -1 if ``owners`` are several. ``hard`` windows need no vote.
    """

    ids: list
    owners: list
    hard: np.ndarray
    numbers: np.ndarray
    data: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    whole: int
    budget: np.ndarray
    least: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    place: np.ndarray
    table: np.ndarray


def index(ids: list[list], texts: list[str | None], edits: float = EDITS) -> Items | None:
    """Distinct texts with the ids of each; None if none has the eight characters it takes to be searched for."""
    raw, offsets = text_bytes(pa.array(texts, pa.large_string()))
    data, offsets = normalise(raw, offsets)
    spans = list(enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())))
    cut = [
        (i, begin, min(begin + WINDOW, end))
        for i, (start, end) in spans
        for begin in range(start, max(start + 1, end - WINDOW // 2), WINDOW // 2)
        if min(begin + WINDOW, end) - begin >= Q
    ]
    if not cut:
        return None
    short = [(i, begin, begin + SHORT) for i, (start, end) in spans if end - start > SHORT for begin in range(start, end - SHORT + 1, STRIDE)]
    seen: dict[bytes, list[int]] = {}
    kept: list = []
    for some in (cut, short):
        for i, start, stop in some:
            own = seen.setdefault(data[start:stop].tobytes(), [])
            if not own:
                kept.append((own, start, stop))
            if i not in own[-1:]:
                own.append(i)
        whole = len(kept) if some is cut else whole
    if len(kept) >= 1 << _WINDOW_BITS:
        raise ValueError("too many windows in one block of items")
    owners = [own for own, _, _ in kept]
    owner = np.array([own[0] if len(own) == 1 else -1 for own in owners], np.int64)
    start, stop = np.array([span for _, *span in kept], np.int64).T.copy()
    sizes = stop - start
    # An item must share one q-gram at least, so short items have a smaller budget.
    budget = np.minimum((sizes * edits).astype(np.int64), (sizes - Q) // Q)
    found = grams(data)
    # Those across the ends of items are in no window.
    place = np.flatnonzero(np.searchsorted(offsets, np.arange(found.size), "right") == np.searchsorted(offsets, np.arange(found.size) + Q, "left"))
    # Nor are those of windows that another stands for.
    edges = np.bincount(start, minlength=data.size + 1) - np.bincount(np.maximum(stop - Q + 1, start), minlength=data.size + 1)
    place = place[np.cumsum(edges)[place] > 0]
    order = place[np.argsort(found[place], kind="stable")]
    distinct, first = np.unique(found[order], return_index=True)
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[distinct * _SPREAD >> np.uint64(64 - _TABLE_BITS)] = True
    least = sizes - Q + 1 - budget * Q
    first = np.append(first, order.size)
    numbers = np.full(data.size + 1, -1, np.int64)
    numbers[order] = np.repeat(np.arange(distinct.size), np.diff(first))
    common = np.concatenate(([0], np.cumsum((numbers >= 0) & (np.diff(first)[numbers] > COMMON))))
    needed = least - (common[np.maximum(stop - Q + 1, start)] - common[start])
    hard = needed < 1
    return Items(
        ids, owners, hard, numbers, data, owner, start, stop, whole, budget, np.where(hard, np.iinfo(np.int64).max, needed),
        distinct, first, order, table,
    )


def align(items: Items, data: np.ndarray, item: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least edits between each item and a part of ``data[begin:end]`` near the diagonals from ``low`` on."""
    sizes = (items.stop - items.start)[item]
    most = int(items.budget[item].max())
    width, rows = 4 * most + 2, int(sizes.max())
    at = (low - items.budget[item])[:, None] + np.arange(rows + width)
    inside = (at >= begin[:, None]) & (at < end[:, None])
    text = np.where(inside, data[np.clip(at, 0, max(data.size - 1, 0))], 0)
    wanted = items.start[item][:, None] + np.arange(rows)
    wanted = items.data[np.minimum(wanted, items.data.size - 1)]
    best = np.full(item.size, np.iinfo(np.int16).max, np.int16)
    ramp = np.arange(width, dtype=np.int16)
    cost = np.zeros((item.size, width), np.int16)
    for row in range(rows):
        step = cost + (text[:, row : row + width] != wanted[:, row : row + 1])
        np.minimum(step[:, :-1], cost[:, 1:] + 1, out=step[:, :-1])
        cost = np.minimum.accumulate(step - ramp, axis=1) + ramp
        done = sizes == row + 1
        if done.any():
            best[done] = cost[done].min(axis=1)
    return best


def find(items: Items, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, item window, edits)`` of every quotation within budget."""
    data, offsets = normalise(*text_bytes(column))
    # Parts of long texts overlap by more than an item and its band.
    reach = WINDOW + 8 * int(items.budget.max()) + Q
    text, begin, end = [], [], []
    for number, (start, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for part in range(start, max(start + 1, stop - reach), PART):
            text.append(number)
            begin.append(part)
            end.append(min(part + PART + reach, stop))
    text, begin, end = (np.array(x, np.int64) for x in (text, begin, end))
    out = [np.empty(0, np.int64)] * 3
    group_start = 0
    while group_start < text.size:
        group_end = max(group_start + 1, int(np.searchsorted(end, begin[group_start] + PART, "right")))
        found = _find(items, data, begin[group_start:group_end], end[group_start:group_end])
        out = [np.concatenate([a, b]) for a, b in zip(out, (text[group_start + found[0]], found[1], found[2]))]
        group_start = group_end
    return out[0], out[1], out[2]


def _find(items: Items, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
    base = begin[0]
    gram = grams(data[base : end[-1]])
    at = np.flatnonzero(items.table[gram * _SPREAD >> np.uint64(64 - _TABLE_BITS)])
    known = np.minimum(np.searchsorted(items.grams, gram[at]), items.grams.size - 1)
    same = items.grams[known] == gram[at]
    at, known = at[same] + base, known[same]
    part = np.searchsorted(begin, at, "right") - 1
    inside = at + Q <= end[part]
    at, known, part = at[inside], known[inside], part[inside]
    found = [np.empty(0, np.int64)] * 3
    for window in np.flatnonzero(items.hard).tolist() if at.size else ():
        found = _joined(found, _repetitive(items, data, begin, end, at, known, part, window))
    counts = items.first[known + 1] - items.first[known]
    some = counts <= COMMON
    at, known, part, counts = at[some], known[some], part[some], counts[some]
    together = counts.sum() <= TOGETHER
    # In the order of the text; a position has few places.
    cuts = [0, at.size] if together else np.searchsorted(np.cumsum(counts), np.arange(0, counts.sum() + SLICE, SLICE), "right").tolist() + [at.size]

    def hits(first: int):
        for lo, hi in zip(cuts, cuts[1:]):
            n = counts[lo:hi]
            place, where, own = items.place[_ranges(items.first[known[lo:hi]], n)], np.repeat(at[lo:hi], n), np.repeat(part[lo:hi], n)
            if together and first:
                dense = _dense(items, place, where - base, own)
                place, where, own = place[dense], where[dense], own[dense]
            for begun in range(0, max(place.size, 1), SLICE):
                inside = slice(begun, begun + SLICE)
                yield where[inside], place[inside], own[inside]

    found = _joined(found, _aligned(items, data, base, begin, end, hits(0), 0, items.whole))
    if items.whole == items.start.size:
        return found
    return _joined(found, _aligned(items, data, base, begin, end, hits(1), items.whole, items.start.size, found))


def _joined(a, b):
    return tuple(np.concatenate(both) for both in zip(a, b))


def _repetitive(items: Items, data, begin, end, at, known, part, window: int):
    """``(part, window, edits)`` of a window whose q-grams repeat, where a stretch has enough of them in any order."""
    size, budget = int(items.stop[window] - items.start[window]), int(items.budget[window])
    own = np.unique(items.numbers[items.start[window] : items.stop[window] - Q + 1])
    here = np.flatnonzero(np.isin(known, own))
    least = size - Q + 1 - budget * Q
    width = 2 * (budget + 1)
    out = [np.empty(0, np.int64)] * 3
    for p in np.unique(part[here]).tolist():
        places = at[here[part[here] == p]] - begin[p]
        # Every other cell of diagonals begins a band; a quotation on it ends before the next size and budget.
        bands = np.unique(places // width)
        bands = np.unique((bands[:, None] - np.arange(-(-(size + budget) // width) + 2)).ravel())
        low = bands * width
        held = np.searchsorted(places, low + width + size + budget) - np.searchsorted(places, low - budget)
        low = low[held >= least] + begin[p]
        best = items.budget[window] + 1
        for lo in range(0, low.size, 128):
            some = low[lo : lo + 128]
            many = np.full(some.size, window)
            best = min(best, align(items, data, many, some, np.full(some.size, begin[p]), np.full(some.size, end[p])).min())
            if not best:
                break
        if best <= budget:
            out = _joined(out, ([p], [window], [best]))
    return tuple(np.asarray(side, np.int64) for side in out)


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, as many as its count, end to end."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _banded(cells: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bands of two neighbouring cells, by the lower one, and their votes."""
    if not cells.size:
        return cells, votes
    both = np.union1d(cells, cells - np.uint64(1))
    band = np.zeros(both.size, np.int64)
    for cell in (both, both + np.uint64(1)):
        there = np.minimum(np.searchsorted(cells, cell), cells.size - 1)
        band += np.where(cells[there] == cell, votes[there], 0)
    return both, band


def _dense(items: Items, place: np.ndarray, at: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The shared q-grams in bands that hold as many as the short window needs that needs fewest.

    The diagonals are those of the data of all items, so that one count serves all windows.
    """
    width = int(items.budget[items.whole]) + 1
    cell = part.astype(np.uint64) << np.uint64(40) | ((at - place + items.data.size) // width + 1).astype(np.uint64)
    cells, where, votes = np.unique(cell, return_inverse=True, return_counts=True)
    both, band = _banded(cells, votes)
    full = both[band >= items.least[items.whole :].min()]
    return np.flatnonzero((np.isin(cells, full) | np.isin(cells, full + np.uint64(1)))[where])


_PART_SHIFT, _WINDOW_SHIFT = np.uint64(_WINDOW_BITS + _CELL_BITS), np.uint64(_CELL_BITS)


def _split(items: Items, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, window and number of cells."""
    window = (cells >> _WINDOW_SHIFT & np.uint64((1 << _WINDOW_BITS) - 1)).astype(np.int64)
    return (cells >> _PART_SHIFT).astype(np.int64), window, (cells & np.uint64((1 << _CELL_BITS) - 1)).astype(np.int64)


def _votes(items: Items, base, at, place, part, first: int, last: int, pairs, done) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the windows from ``first`` to ``last`` that shared q-grams fall into, and how many each."""
    low = first + np.searchsorted(items.stop[first:last], place + Q, "left")
    counts = np.maximum(first + np.searchsorted(items.start[first:last], place, "right") - low, 0)
    window, at, place, part = _ranges(low, counts), np.repeat(at, counts), np.repeat(place, counts), np.repeat(part, counts)
    keep = ~items.hard[window]
    if pairs is not None:
        keep &= np.isin(part * (len(items.ids) + 1) + items.owner[window] + 1, pairs, invert=True)
    if done.size:
        keep &= np.isin(part << _WINDOW_BITS | window, done, invert=True)
    if not keep.all():
        window, at, place, part = window[keep], at[keep], place[keep], part[keep]
    # Diagonals from zero up, in cells of k + 1; two neighbouring cells are one band.
    diagonal = at - base - (place - items.start[window]) + WINDOW
    cell = diagonal // (items.budget[window] + 1) + 1
    return np.unique(part.astype(np.uint64) << _PART_SHIFT | window.astype(np.uint64) << _WINDOW_SHIFT | cell.astype(np.uint64), return_counts=True)


def _aligned(items: Items, data, base, begin, end, hits, first: int, last: int, known=None):
    """``(part, window, edits)`` of the windows from ``first`` to ``last`` within budget.

    ``hits`` come in slices in the order of the text. Cells that later ones can no longer fall into
    are settled after each slice; where a window is found without an edit, it is looked for no more in that part. Items that are ``known`` to be quoted in a part are not
    looked for in it again.
    """
    pairs = None
    if known is not None:
        owner = items.owner[known[1]]
        pairs = (known[0] * (len(items.ids) + 1) + owner + 1)[owner >= 0]
    cells, votes = np.empty(0, np.uint64), np.empty(0, np.int64)
    out = [np.empty(0, np.int64)] * 3
    done = np.empty(0, np.int64)
    slices = iter(hits)
    ahead = next(slices, None)
    while ahead is not None:
        (at, place, part), ahead = ahead, next(slices, None)
        new = _votes(items, base, at, place, part, first, last, pairs, done)
        if cells.size:
            cells, where = np.unique(np.concatenate((cells, new[0])), return_inverse=True)
            votes = np.bincount(where, np.concatenate((votes, new[1]))).astype(np.int64)
        else:
            cells, votes = new
        both, band = _banded(cells, votes)
        own, window, cell = _split(items, both)
        settled = np.ones(both.size, bool)
        if ahead is not None and at.size:
            # A q-gram further on in the text lies on a diagonal above this one, for every window.
            upto = int(at[-1]) - base
            settled = (own < part[-1]) | ((cell + 1) * (items.budget[window] + 1) <= upto)
            mine, of, number = _split(items, cells)
            # A settled cell is still the lower half of nothing but may be the upper half of an open band.
            open_ = (mine >= part[-1]) & ((number + 2) * (items.budget[of] + 1) > upto)
            cells, votes = cells[open_], votes[open_]
        passed = np.flatnonzero(settled & (band >= items.least[window]))
        own, window, cell = own[passed], window[passed], cell[passed]
        low = (cell - 1) * (items.budget[window] + 1) - WINDOW + base
        order = np.argsort((items.stop - items.start)[window], kind="stable")
        edits = np.full(window.size, np.iinfo(np.int64).max)
        for some in np.split(order, range(128, order.size, 128)):
            if done.size:
                some = some[np.isin(own[some] << _WINDOW_BITS | window[some], done, invert=True)]
            if some.size:
                edits[some] = align(items, data, window[some], low[some], begin[own[some]], end[own[some]])
                exact = some[edits[some] == 0]
                done = np.union1d(done, own[exact] << _WINDOW_BITS | window[exact]) if exact.size else done
        good = edits <= items.budget[window]
        out = _joined(out, (own[good], window[good], edits[good]))
    return out


def _blocks(benchmark: DataFrame, key: str, text: str, limit: int) -> list:
    """The items as broadcast indexes of at most about ``limit`` bytes each.

    Equal items are one, with all their ids, and long ones are parts that overlap by a window.
    """
    kept = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = benchmark.select(F.col(key).alias("id"), F.regexp_replace(kept, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ").alias("text"))
    rows = rows.groupBy("text").agg(F.collect_list("id").alias("ids"))
    last = F.greatest(F.length("text") - WINDOW - 1, F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), last, F.lit(SEGMENT)), lambda at: F.substring(F.col("text"), at + 1, F.lit(SEGMENT + WINDOW)))
    rows = materialize(rows.select("ids", F.explode(parts).alias("text")))
    # Each item counts 24 bytes more, which bounds the number of items of a block too.
    size = rows.agg(F.sum(F.octet_length("text") + 24)).first()[0] or 0
    count = 1 + 2 * size // limit if size > limit else 1
    out = []
    for number in range(count):
        own = rows if count == 1 else rows.filter(F.pmod(F.xxhash64("text"), F.lit(count)) == number)
        found = sorted(own.collect(), key=lambda r: (r.text, r.ids))
        if (items := index([list(r.ids) for r in found], [r.text for r in found])) is not None:
            out.append(benchmark.sparkSession.sparkContext.broadcast(vars(items)))
    return out


def _search(items):
    """For each row of a batch: its items so far and those of this block, and the least edits."""

    def task(batches):
        block = Items(**items.value)
        for batch in batches:
            for piece in pieces(batch, "text"):
                text, window, edits = find(block, piece.column("text"))
                lists, least = piece.column("items").to_pylist(), piece.column("edits").to_pylist()
                for t, w, e in zip(text.tolist(), window.tolist(), edits.tolist()):
                    lists[t] = [*lists[t], *(one for owner in block.owners[w] for one in block.ids[owner])]
                    least[t] = e if least[t] is None else min(least[t], e)
                columns = [piece.column("id"), piece.column("text"), pa.array(lists, piece.schema.field("items").type), pa.array(least, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, piece.schema.names)

    return task


def quotations(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(key, contaminated, items, edits)`` per row of ``docs``.

    ``items`` are the distinct ids of the quoted items in order, ``edits`` the least number of
    edits (null without any); an item counts with those of its passages only where it is not
    quoted as a whole, or by a window of 800 characters if it is longer. Null texts are empty and quote nothing; items of fewer than
    eight normalised characters, null ones too, are not searched for, and items with a null id
    count but are not listed. Repeated rows stay apart.
    """
    kind = benchmark.schema[item_key].dataType.simpleString()
    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.expr(f"cast(array() as array<{kind}>)").alias("items"), F.expr("cast(null as bigint)").alias("edits"),
    )
    for items in _blocks(benchmark, item_key, item_text, block_bytes):
        rows = rows.mapInArrow(_search(items), rows.schema)
    listed = F.array_sort(F.array_distinct("items"))
    return rows.select(F.col("id").alias(key), F.col("edits").isNotNull().alias("contaminated"), listed.alias("items"), "edits")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that quote no item, with all their columns."""

    def keep(items):
        def task(batches):
            block = Items(**items.value)
            for batch in batches:
                for piece in pieces(batch, text):
                    clean = np.ones(piece.num_rows, bool)
                    clean[find(block, piece.column(text))[0]] = False
                    yield piece.filter(pa.array(clean))

        return task

    for items in _blocks(benchmark, item_key, item_text, block_bytes):
        docs = docs.mapInArrow(keep(items), docs.schema)
    return docs
