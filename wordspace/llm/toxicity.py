"""Toxicity of texts by a counterfactually regularised classifier (Garg et al. 2019).

A text is its words, word pairs and beginnings of words, each with how often it occurs (once,
twice, four times); those are looked at that say most about the label. Weights are fitted by logistic
regression with a second penalty: sentences of labelled texts that name a group of people
are paired with the same sentences naming another group of the same kind, and the square of the
difference of their scores is added to the loss. So what the labels happen to say about a
group moves to the words around it, and a neutral mention does not make a text toxic.

Counting, the choice of features and the pairing run in Spark over the labelled texts; the
driver fits at most ``sample`` rows and ``pairs`` pairs of as many bits as there are features.
Scoring is a map over all texts, in which no row moves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordspace.llm.packed import Tally
from wordspace.llm.tokens import word_lists
from wordspace.llm.words import LOWER, mix, pieces, span_hashes, spans, text_bytes
from wordspace.sources.scratch import materialize

#: Most labelled rows and most pairs of sentences a model is fitted on, in the order of a hash.
SAMPLE, PAIRS = 20_000, 20_000
#: Features chosen, and in how many labelled texts one has to be.
FEATURES, LEAST = 768, 3
#: Beginnings of words of so many bytes count like words, and so many counts are told apart.
BEGINNINGS, LEVELS = (4, 5, 6, 7, 8), 3
#: A text whose score is at least this is toxic.
TOXIC = 0.5
#: Weight of the squared weights, and of the squared score differences of pairs.
RIDGE, FAIR = 0.25, 1.0
#: Most Newton steps of a fit, and rows of one addition to its matrix.
STEPS, ROWS = 30, 2048

#: Names of groups; a name is swapped for one of the same row.
GROUPS = (
    "women men girls boys",
    "woman man girl boy",
    "female male",
    "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist",
    "black white asian latino arab indigenous",
    "blacks whites asians latinos arabs",
    "gay straight lesbian bisexual transgender",
    "immigrants refugees natives foreigners citizens",
    "immigrant refugee native foreigner citizen",
    "americans mexicans chinese russians germans africans indians",
    "american mexican african russian german french indian",
    "old young elderly",
    "deaf blind disabled",
    "frauen männer", "muslime christen juden", "femmes hommes", "musulmans chrétiens juifs", "mujeres hombres",
    "musulmanes cristianos judíos",
)

_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_WORD[128:] = True
_SENTENCES = re.compile("[.!?\n\r]+")
_SALT = np.uint64(0x9E3779B97F4A7C15)
#: The last bits of a feature are the level of its count.
_LEVEL = np.uint64(3)


def _kinds(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and texts of all words, of all word pairs, and of all beginnings of each length."""
    raw, offsets = text_bytes(column)
    if not raw.size:
        return
    raw = LOWER[raw]
    starts, ends, bounds = spans(raw, offsets, _WORD)
    owner = np.repeat(np.arange(len(column)), np.diff(bounds))
    words = span_hashes(raw, starts, ends)
    yield words, owner
    together = np.flatnonzero(owner[1:] == owner[:-1])
    yield mix(words[together] * _SALT + words[together + 1]), owner[together]
    for length in BEGINNINGS:
        long = np.flatnonzero(ends - starts + 1 >= length)
        begun = starts[long]
        yield mix(span_hashes(raw, begun, begun + length - 1) + _SALT), owner[long]


def _counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, feature)``: each hash of a text once for every level its count reaches there."""
    hashes = hashes & ~_LEVEL
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(hashes.size, bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(first)
    counts = np.diff(np.append(first, hashes.size))
    hashes, owner = hashes[first], owner[first]
    levels = [counts >= 1 << level for level in range(LEVELS)]
    features = [hashes[reached] | np.uint64(level) for level, reached in enumerate(levels)]
    return np.concatenate([owner[reached] for reached in levels]), np.concatenate(features)


def _cells(column: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and place among the sorted ``chosen`` of the chosen features of the texts."""
    bases = np.unique(chosen & ~_LEVEL)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for hashes, owner in _kinds(column) if chosen.size else ():
        at = np.minimum(np.searchsorted(bases, hashes & ~_LEVEL), bases.size - 1)
        some = np.flatnonzero(bases[at] == hashes & ~_LEVEL)
        owner, features = _counted(hashes[some], owner[some])
        at = np.minimum(np.searchsorted(chosen, features), chosen.size - 1)
        some = chosen[at] == features
        found.append((owner[some], at[some]))
    return tuple(np.concatenate(side) for side in zip(*found))


def _bits(column: pa.Array, chosen: np.ndarray) -> pa.Array:
    """Which of the ``chosen`` features each text has, a bit each."""
    table = np.zeros((len(column), max(chosen.size, 1)), bool)
    table[_cells(column, chosen)] = True
    return pa.array([row.tobytes() for row in np.packbits(table, axis=1)], pa.binary())


@dataclass
class Model:
    """Sorted features, their weights, and the score of a text with none."""

    start: float
    chosen: np.ndarray
    weights: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of label 1 of each text."""
        owner, at = _cells(column, self.chosen)
        total = self.start + np.bincount(owner, self.weights[at], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, ridge: float = RIDGE, fair: float = FAIR) -> tuple[float, np.ndarray]:
    """Start and weights for the rows ``x`` labelled ``y``, where pairs ``a``, ``b`` are to score alike.

    The loss is that of logistic regression, ``ridge / 2`` times the squared weights and
    ``fair / 2`` times the squared differences ``(a - b) @ weights``, all over the rows; minimised by
    Newton steps, halved where one does not lower it. Without rows, or of one label, nearly
    the same is said of all.
    """
    rate = (y.sum() + 0.5) / (y.size + 1)
    many = x.shape[1]
    w = np.zeros(many + 1)
    w[-1] = np.log(rate / (1 - rate))
    if not y.size or y.min() == y.max():
        return float(w[-1]), w[:-1]

    def parts(rows):
        for begin in range(0, rows.shape[0], ROWS):
            yield slice(begin, begin + ROWS), rows[begin : begin + ROWS].astype(np.float64)

    bent = np.zeros((many + 1, many + 1))
    bent[np.arange(many), np.arange(many)] = ridge
    for at, part in parts(a):
        part -= b[at]
        bent[:many, :many] += fair * (part.T @ part)

    def scores(w):
        return np.concatenate([part @ w[:-1] + w[-1] for _, part in parts(x)])

    def loss(w, z):
        return (np.logaddexp(0, z) - y * z).sum() + w @ bent @ w / 2

    z = scores(w)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-z))
        slope, curve = bent @ w, bent.copy()
        for at, part in parts(x):
            part = np.column_stack((part, np.ones(part.shape[0])))
            slope += part.T @ (p[at] - y[at])
            curve += (part * (p[at] * (1 - p[at]))[:, None]).T @ part
        step, size, before = np.linalg.solve(curve, slope), 1.0, loss(w, z)
        while size > 1e-4 and loss(w - size * step, after := scores(w - size * step)) > before:
            size /= 2
        if size <= 1e-4:
            break
        w, z = w - size * step, after
        if np.abs(size * step).max() < 1e-6:
            break
    return float(w[-1]), w[:-1]


def _label_counts(found: DataFrame) -> DataFrame:
    """``(hash, n0, n1)``: how many texts of either label have a feature."""

    def task(batches):
        tallies = Tally(), Tally()

        def rows(label, keys, counts):
            none = np.zeros(keys.size, np.int64)
            columns = [keys.view(np.int64), *((none, counts) if label else (counts, none))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "n0", "n1"])

        for batch in batches:
            for piece in pieces(batch, "text"):
                labels = piece.column("label").to_numpy()
                for hashes, owner in _kinds(piece.column("text")):
                    owner, features = _counted(hashes, owner)
                    for value in (0, 1):
                        out = tallies[value].add(features[labels[owner] == value])
                        if out is not None:
                            yield rows(value, *out)
        for value in (0, 1):
            yield rows(value, *tallies[value].take())

    counted = found.mapInArrow(task, "hash bigint, n0 bigint, n1 bigint")
    return counted.groupBy("hash").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def choose(found: DataFrame, many: int = FEATURES, least: int = LEAST) -> np.ndarray:
    """The ``many`` features whose presence says most about the label, sorted."""
    totals = found.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")).first()
    if not totals.n0 or not totals.n1:
        return np.empty(0, np.uint64)
    rows = float(totals.n0 + totals.n1)

    def part(seen: Column, label: int, side: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * rows / (side * float(label)))).otherwise(0.0)

    has = F.col("n0") + F.col("n1")
    lacks = F.lit(rows) - has
    says = part(F.col("n0"), totals.n0, has) + part(F.col("n1"), totals.n1, has)
    says += part(F.lit(totals.n0) - F.col("n0"), totals.n0, lacks) + part(F.lit(totals.n1) - F.col("n1"), totals.n1, lacks)
    kept = _label_counts(found).filter(has >= least).orderBy(F.desc(says), "hash").limit(many).select("hash").collect()
    return np.sort(np.array([row["hash"] for row in kept], np.int64).view(np.uint64))


def swaps(groups: tuple[str, ...] = GROUPS) -> dict[bytes, list[bytes]]:
    """For each name the others of its row, from its right neighbour on."""
    out = {}
    for row in groups:
        own = row.encode().split()
        if len(own) < 2:
            raise ValueError(f"a group needs a name to swap with: {row}")
        out.update((name, own[i + 1 :] + own[:i]) for i, name in enumerate(own))
    return out


def swapped(text: str | None, others: dict[bytes, list[bytes]]) -> Iterator[tuple[bytes, bytes]]:
    """The words of each sentence that names a group, and the same with all names swapped.

    How far a name moves in its row is taken from the sentence, so equal sentences are always
    swapped alike.
    """
    for sentence in _SENTENCES.split(text or ""):
        words = [word for some in word_lists(sentence) for word in some]
        if any(word in others for word in words):
            said = b" ".join(words)
            turn = crc32(said)
            yield said, b" ".join(others[w][turn % len(others[w])] if w in others else w for w in words)


def sentence_pairs(found: DataFrame, chosen: np.ndarray, others: dict[bytes, list[bytes]]) -> DataFrame:
    """``(hash, a, b)``: the features of each sentence that names a group, as it is and swapped."""

    def task(batches):
        for batch in batches:
            for value in batch.column("text"):
                pairs = list(swapped(value.as_py(), others))
                if pairs:
                    sides = [pa.array([word.decode() for word in side]) for side in zip(*pairs)]
                    hashes = pa.array([crc32(said) for said, _ in pairs], pa.int64())
                    yield pa.RecordBatch.from_arrays([hashes, *(_bits(side, chosen) for side in sides)], ["hash", "a", "b"])

    return found.mapInArrow(task, "hash bigint, a binary, b binary")


def _unpacked(values: list, many: int) -> np.ndarray:
    if not values or not many:
        return np.zeros((len(values), many), np.uint8)
    return np.unpackbits(np.frombuffer(b"".join(map(bytes, values)), np.uint8).reshape(len(values), -1), axis=1)[:, :many]


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", learn: Column | None = None,
    sample: int = SAMPLE, pairs: int = PAIRS, many: int = FEATURES, fair: float = FAIR, groups: tuple[str, ...] = GROUPS,
) -> Model:
    """A model of the labels of at most ``sample`` rows among those of ``labels`` that ``learn`` marks.

    Labels other than 0 and 1 are not learned from, nor rows without an id. Several rows of
    one id, on either side, are as many cases, and the limit holds for those too. Nothing but the text is looked
    at. With ``fair=0`` names of groups are words like others.
    """
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    rows = rows if learn is None else rows.filter(learn)
    some = rows.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("key"), "key", "label").limit(sample)
    joined = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(some), "key")
    found = materialize(joined.select("label", "text", F.xxhash64("key", "text").alias("hash")))
    others = swaps(groups)
    chosen = choose(found, many)

    def task(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                columns = [piece.column("hash"), piece.column("label"), _bits(piece.column("text"), chosen)]
                yield pa.RecordBatch.from_arrays(columns, ["hash", "label", "x"])

    cases = found.mapInArrow(task, "hash bigint, label int, x binary").orderBy("hash", "label", "x").limit(sample).collect()
    apart = sentence_pairs(found, chosen, others).filter("a != b").orderBy("hash", "a", "b").limit(pairs).collect() if chosen.size and fair else []
    a, b = (_unpacked([row[side] for row in apart], chosen.size) for side in ("a", "b"))
    start, weights = fit(_unpacked([row.x for row in cases], chosen.size), np.array([row.label for row in cases], float), a, b, fair=fair)
    return Model(start, chosen, weights)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score, predicted)`` per row; null texts are empty, and repeated rows stay apart."""
    parts = vars(model)

    def task(batches):
        own = Model(**parts)
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = own.score(piece.column("text"))
                toxic = (found >= TOXIC).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array(found), pa.array(toxic)], [key, "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(task, f"`{key}` {kind}, score double, predicted int")
