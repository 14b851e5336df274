"""Quality of texts by a generalised additive model with pairwise interactions.

A text is some twenty numbers: how long it is, what its characters, words and lines are, and
how much of it repeats. Shallow trees, each on one feature, are boosted in turn over the
features; summed up they are one lookup table per feature (Lou, Caruana and Gehrke 2012).
Then the pairs of features that say most about what is left get tables of their own in
the same way (2013). A score is a sum of table entries for a batch of texts at once.

The model is fitted on the driver on a bounded sample of labelled rows; scoring is a map
over all texts, in which no row moves.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordspace.llm.words import LOWER, WORD, pieces, span_hashes, spans, text_bytes

#: Most labelled rows a model is fitted on, taken in the order of a hash of their id.
SAMPLE = 20_000
#: A text whose score is below this is of low quality.
ACCEPTED = 0.3

BINS, PAIR_BINS, PAIRS = 64, 12, 10
ROUNDS, PAIR_ROUNDS, RATE = 80, 40, 0.15
#: Added to the weight of a leaf, and least weight of one.
RIDGE, LEAST = 1.0, 2.0

FEATURES = (
    "words", "word_length", "long_words", "short_words", "digits", "capitals", "beyond_ascii", "punctuation", "symbols",
    "symbol_words", "bare_symbols", "sentence_ends", "words_per_sentence", "distinct", "top_word", "repeated", "lines",
    "line_words", "repeated_lines", "top_line", "entropy",
)


def _mark(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_DIGIT, _CAPITAL = _mark("0123456789"), _mark("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_BEYOND = np.arange(256) >= 128
_ALNUM = _DIGIT | _CAPITAL | _mark("abcdefghijklmnopqrstuvwxyz") | _BEYOND
_STOP, _COMMON = _mark(".!?"), _mark(".!?,;:'\"()-")
_SYMBOL = ~_ALNUM & WORD & ~_COMMON
_LINE = ~_mark("\n\r")


def _repeats(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text and how often its most frequent one occurs."""
    counts = np.diff(bounds)
    text = np.repeat(np.arange(counts.size, dtype=np.uint64), counts)
    keys = np.sort(text << np.uint64(44) | hashes >> np.uint64(20))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if keys.size else np.empty(0, np.int64)
    runs = np.diff(np.append(first, keys.size))
    owner = (keys[first] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(counts.size, np.int64)
    np.maximum.at(top, owner, runs)
    return np.bincount(owner, minlength=counts.size), top


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; all zero for one without characters."""
    raw, offsets = text_bytes(column)
    size = np.diff(offsets)
    chars, n = np.maximum(size, 1), len(column)

    def upto(marks):
        return np.concatenate(([0], np.cumsum(marks[raw])))

    def share(marks):
        sums = upto(marks)
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / chars

    def per_text(values, bounds):
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    starts, ends, bounds = spans(raw, offsets, WORD)
    count = np.diff(bounds)
    words = np.maximum(count, 1)
    hashes = span_hashes(LOWER[raw], starts, ends)
    length = ends - starts + 1
    symbols, alnum = upto(_SYMBOL), upto(_ALNUM)
    stops = per_text(_STOP[raw[ends]], bounds)
    same = np.concatenate(([False], hashes[1:] == hashes[:-1])) if hashes.size else np.empty(0, bool)
    same[bounds[:-1][count > 0]] = False
    distinct, top = _repeats(hashes, bounds)
    line_starts, line_ends, line_bounds = spans(raw, offsets, _LINE)
    lines = np.diff(line_bounds)
    line_hashes = span_hashes(raw, line_starts, line_ends)
    line_distinct, line_top = _repeats(line_hashes, line_bounds)
    entropy = np.zeros(n)
    for i in np.flatnonzero(size):
        p = np.bincount(raw[offsets[i] : offsets[i + 1]], minlength=256) / size[i]
        entropy[i] = -(p[p > 0] * np.log2(p[p > 0])).sum()
    columns = (
        np.log1p(count), per_text(length, bounds) / words, per_text(length > 12, bounds) / words, per_text(length < 4, bounds) / words,
        share(_DIGIT), share(_CAPITAL), share(_BEYOND), share(_COMMON), share(_SYMBOL),
        per_text(symbols[ends + 1] > symbols[starts], bounds) / words, per_text(alnum[ends + 1] == alnum[starts], bounds) / words,
        stops / words, np.log1p(count / (stops + 1)), distinct / words, top / words, per_text(same, bounds) / words,
        np.log1p(lines), np.log1p(count / np.maximum(lines, 1)), 1 - line_distinct / np.maximum(lines, 1) * (lines > 0) - (lines == 0),
        line_top / np.maximum(lines, 1) * (lines > 1), entropy,
    )
    return np.column_stack(columns).astype(np.float64)


@dataclass
class Model:
    """Bin edges and tables; ``pairs`` holds the features of each pair table."""

    start: float
    edges: list
    tables: list
    pairs: list
    pair_edges: list
    pair_tables: list

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row of features."""
        total = np.full(x.shape[0], self.start)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        coarse = [np.searchsorted(edges, x[:, j], "right") for j, edges in enumerate(self.pair_edges)]
        for (j, k), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[j], coarse[k]]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) + 1e-12


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0 if none gains."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
    gain[(left_h < LEAST) | (all_h - left_h < LEAST)] = 0
    if not gain.size or gain.max() <= 1e-9:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return RATE * g.sum() / (h.sum() + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of two levels over the bins of one feature, as a value per bin."""
    out = np.zeros(g.size)
    _, middle = _cut(g, h)
    for begin, end in ((0, middle), (middle, g.size)) if middle else ():
        _, at = _cut(g[begin:end], h[begin:end])
        for a, b in ((begin, begin + at), (begin + at, end)) if at else ((begin, end),):
            out[a:b] = _leaf(g[a:b], h[a:b])
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The better tree of a cut by one feature and then by the other; its gain and values."""
    best = 0.0, np.zeros(g.shape)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        out, (gain, middle) = np.zeros(a.shape), _cut(a.sum(axis=1), b.sum(axis=1))
        if not middle:
            # A pure interaction shows only after both cuts, so the first is the middle.
            middle = a.shape[0] // 2
        for rows in (slice(0, middle), slice(middle, a.shape[0])):
            more, at = _cut(a[rows].sum(axis=0), b[rows].sum(axis=0))
            gain += more
            for columns in (slice(0, at), slice(at, a.shape[1])) if at else (slice(None),):
                out[rows, columns] = _leaf(a[rows, columns], b[rows, columns])
        if gain > best[0]:
            best = gain, out.T if turned else out
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of labels 0 and 1; without rows or of one label it says nearly the same of all."""
    rate = (y.sum() + 0.5) / (y.size + 1)
    start = float(np.log(rate / (1 - rate)))
    many = range(x.shape[1])
    edges = [_edges(x[:, j], BINS) if y.size else np.empty(0) for j in many]
    bins = [np.searchsorted(edges[j], x[:, j], "right") for j in many]
    tables = [np.zeros(edges[j].size + 1) for j in many]
    total = np.full(y.size, start)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS if y.size else 0):
        for j in many:
            g, h = slopes()
            size = tables[j].size
            step = _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size))
            tables[j] += step
            total += step[bins[j]]

    pair_edges = [_edges(x[:, j], PAIR_BINS) if y.size else np.empty(0) for j in many]
    coarse = [np.searchsorted(pair_edges[j], x[:, j], "right") for j in many]

    def grid(j, k, values):
        shape = pair_edges[j].size + 1, pair_edges[k].size + 1
        return np.bincount(coarse[j] * shape[1] + coarse[k], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = sorted(((_pair_tree(grid(j, k, g), grid(j, k, h))[0], j, k) for j, k in combinations(many, 2)), reverse=True)
    pairs = [(j, k) for gain, j, k in gains[:PAIRS] if gain > 0] if y.size else []
    pair_tables = [np.zeros((pair_edges[j].size + 1, pair_edges[k].size + 1)) for j, k in pairs]
    for _ in range(PAIR_ROUNDS):
        for table, (j, k) in zip(pair_tables, pairs):
            g, h = slopes()
            step = _pair_tree(grid(j, k, g), grid(j, k, h))[1]
            table += step
            total += step[coarse[j], coarse[k]]
    return Model(start, edges, tables, pairs, pair_edges, pair_tables)


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    learn: Column | None = None, sample: int = SAMPLE,
) -> Model:
    """A model of the labels of at most ``sample`` rows among those of ``labels`` that ``learn`` marks.

    Labels other than 0 and 1 are not learned from, nor rows without an id. Several rows of
    one id are as many cases. Nothing but the text is looked at.
    """
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    rows = rows if learn is None else rows.filter(learn)
    # The limit bounds the broadcast.
    some = rows.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label")).orderBy(F.xxhash64("key"), "key", "label").limit(sample)
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(some), "key")

    def task(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                x = features(piece.column("text"))
                columns = [piece.column("key"), piece.column("label"), pa.array(list(x), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "label", "x"])

    kind = docs.schema[key].dataType.simpleString()
    # An id may be that of many rows, so what is collected is bounded once more.
    cases = found.mapInArrow(task, f"key {kind}, label double, x array<double>")
    rows = cases.orderBy(F.xxhash64("key", "x"), "key", "label", "x").limit(sample).collect()
    rows.sort(key=lambda r: (r.key, r.label, r.x))
    return fit(np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([r.label for r in rows], float))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score, predicted)`` per row; null texts are empty, and repeated rows stay apart."""
    parts = vars(model)

    def task(batches):
        own = Model(**parts)
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = own.score(features(piece.column("text")))
                accepted = (found >= ACCEPTED).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array(found), pa.array(accepted)], [key, "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(task, f"`{key}` {kind}, score double, predicted int")


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is accepted, with all their columns."""
    parts = vars(model)

    def task(batches):
        own = Model(**parts)
        for batch in batches:
            for piece in pieces(batch, text):
                yield piece.filter(pa.array(own.score(features(piece.column(text))) >= ACCEPTED))

    return docs.mapInArrow(task, docs.schema)
