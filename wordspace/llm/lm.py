"""Interpolated modified Kneser-Ney bigram model, counted in Spark, scored from mapped arrays.

    P(w|u) = max(c(u,w) - D(c), 0) / c(u) + (D1 n1(u) + D2 n2(u) + D3 n3(u)) / c(u) * P(w)
    P(w)   = max(l(w) - D'(l), 0) / L + left-over / (V + 1)

c counts in the training texts, n1, n2, n3 are the numbers of words seen once, twice and
more after u, l(w) the number of words seen before w, L their sum, and the discounts come
from the counts of counts as in Chen and Goodman (1998). Each text is a start, its words
and an end. A word not seen in training shares the uniform part.

Three jobs build a model, each with one shuffle of packed blocks that map tasks have
added up before:

1. words: hash -> count, split by the top bits of the hash. The place of a word in all
   sorted hashes is its number.
2. word pairs: (number, number) -> count, split by the first word; pairs that begin with
   a frequent word (bounded in number, as each has a set share of all tokens) are spread by both.
3. the per-word sums n1, n2, n3 and l, added up over the buckets of job 2.

The results are files of sorted arrays in the shared folder. Scoring maps them and looks
up each batch's distinct words and pairs in sorted order, so neighbouring pages are
read once per batch and no model has to fit a worker.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordspace.llm.packed import BLOCK_DDL, Tally, blocks, merge, tally
from wordspace.llm.shared import map_array, write_array
from wordspace.llm.words import mix, pieces, word_hashes
from wordspace.sources.scratch import materialize, scratch_path

#: The word that ends each text; its hash is a fixed value outside the words' own.
END = np.uint64(0x00E4D0F7E27E4D01)

NUMBERS = 1 << 32


@dataclass(frozen=True)
class Model:
    """Where the arrays of a model lie, and its totals."""

    path: str
    word_starts: tuple[int, ...]
    pair_buckets: int
    hot: tuple[int, ...]
    texts: int
    tokens: int
    words: int
    pairs: int
    discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    left_over: float


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts; (0.5, 1, 1.5) where counts of counts give none in range."""
    if n1 and n2 and n3 and n4:
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 < d < k for k, d in enumerate(found, 1)):
            return found
    return 0.5, 1.0, 1.5


def _bucket_of_hash(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _bucket_of_pair(pairs: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    first = pairs >> np.uint64(32)
    spread = np.isin(first, hot) if hot.size else np.zeros(first.size, bool)
    return (mix(np.where(spread, pairs, first)) % np.uint64(buckets)).astype(np.int64)


def _with_ends(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and ends of a piece, and the number of tokens of each text."""
    hashes, bounds = word_hashes(batch.column("text"))
    return np.insert(hashes, bounds[1:], END), np.diff(bounds) + 1


def _count_words(buckets: int):
    def task(batches):
        counted = Tally()

        def out(found):
            return blocks(*found, _bucket_of_hash(found[0], buckets))

        for batch in batches:
            for piece in pieces(batch, "text"):
                if (full := counted.add(_with_ends(piece)[0])) is not None:
                    yield out(full)
        yield out(counted.take())

    return task


WORD_TOTALS = pa.schema(
    [(name, pa.int64()) for name in ("bucket", "words", "tokens", "texts")]
    + [("top", pa.list_(pa.int64())), ("top_counts", pa.list_(pa.int64()))]
)
WORD_TOTALS_DDL = "bucket bigint, words bigint, tokens bigint, texts bigint, top array<bigint>, top_counts array<bigint>"


def _store_words(path: str):
    def group(key, table):
        bucket = key[0].as_py()
        hashes, counts = merge(table)
        write_array(f"{path}/words/{bucket}.hash", hashes)
        write_array(f"{path}/words/{bucket}.count", counts)
        top = np.argsort(-counts, kind="stable")[:64]
        row = (bucket, hashes.size, counts.sum(), counts[hashes == END].sum(), top, counts[top])
        return pa.table([pa.array([v], f.type) for v, f in zip(row, WORD_TOTALS)], schema=WORD_TOTALS)

    return group


class Words:
    """The mapped word arrays of a model."""

    def __init__(self, path: str, starts):
        self.path, self.starts, self.open = path, np.asarray(starts, np.int64), {}

    def array(self, bucket: int, name: str, dtype) -> np.ndarray:
        key = bucket, name
        if key not in self.open:
            self.open[key] = map_array(f"{self.path}/words/{bucket}.{name}", dtype)
        return self.open[key]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, ``-1`` where it is unknown; hashes come sorted."""
        buckets = self.starts.size - 1
        out = np.full(hashes.size, -1, np.int64)
        edges = np.searchsorted(_bucket_of_hash(hashes, buckets), np.arange(buckets + 1))
        for bucket in np.flatnonzero(np.diff(edges)):
            own = hashes[edges[bucket] : edges[bucket + 1]]
            known = self.array(bucket, "hash", np.uint64) if self.starts[bucket + 1] > self.starts[bucket] else own[:0]
            if known.size:
                at = np.minimum(np.searchsorted(known, own), known.size - 1)
                out[edges[bucket] : edges[bucket + 1]] = np.where(known[at] == own, at + self.starts[bucket], -1)
        return out

    def values(self, name: str, dtype, numbers: np.ndarray) -> np.ndarray:
        """A per-word value for sorted numbers."""
        out = np.zeros(numbers.size, dtype)
        edges = np.searchsorted(numbers, self.starts)
        edges[-1] = numbers.size  # the start of a text comes after the last word
        for bucket in np.flatnonzero(np.diff(edges)):
            own = slice(edges[bucket], edges[bucket + 1])
            out[own] = self.array(bucket, name, dtype)[numbers[own] - self.starts[bucket]]
        return out


def _pairs(batch: pa.RecordBatch, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each token and of the one before it (the start is ``V``), and tokens per text."""
    hashes, lengths = _with_ends(batch)
    distinct, back = np.unique(hashes, return_inverse=True)
    second = words.numbers(distinct)[back]
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[np.cumsum(lengths) - lengths] = words.starts[-1]
    return first, second, lengths


def _count_pairs(path: str, starts, hot, buckets: int):
    def task(batches):
        words, often, counted = Words(path, starts), np.array(hot, np.uint64), Tally()

        def out(found):
            return blocks(*found, _bucket_of_pair(found[0], often, buckets))

        for batch in batches:
            for piece in pieces(batch, "text"):
                first, second, _ = _pairs(piece, words)
                keys = first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
                if (full := counted.add(keys)) is not None:
                    yield out(full)
        yield out(counted.take())

    return task


#: Most groups in which the per-word sums are added up, so that a bucket of pairs hands on a bounded number of blocks.
SUM_GROUPS = 128


def _group_starts(starts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """First bucket of words, and first number, of each group of neighbouring buckets."""
    groups = min(buckets, SUM_GROUPS)
    first = -(-np.arange(groups + 1) * buckets // groups)
    return first, np.asarray(starts, np.int64)[first]


def _store_pairs(path: str, starts):
    """Writes one bucket of pairs; hands on its per-word sums, and its counts of counts as bucket -1."""
    _, edges = _group_starts(starts, len(starts) - 1)

    def group(key, table):
        bucket = key[0].as_py()
        keys, counts = merge(table)
        write_array(f"{path}/pairs/{bucket}.key", keys)
        write_array(f"{path}/pairs/{bucket}.count", np.minimum(counts, 255).astype(np.uint8))
        large = np.flatnonzero(counts > 254)
        write_array(f"{path}/pairs/{bucket}.at", large.astype(np.int64))
        write_array(f"{path}/pairs/{bucket}.large", counts[large])
        first, second = keys >> np.uint64(32), keys & np.uint64(NUMBERS - 1)
        # The last two bits say which sum of a word it is: n1, n2, n3, or the words before it.
        after = first << np.uint64(2) | (np.minimum(counts, 3) - 1).astype(np.uint64)
        sums, total = tally(np.concatenate([after, second << np.uint64(2) | np.uint64(3)]))
        # The start has the number after the last word and belongs to the last group.
        at = np.minimum(np.searchsorted(edges, (sums >> np.uint64(2)).astype(np.int64), "right") - 1, edges.size - 2)
        of_counts = np.bincount(np.minimum(counts, 5), minlength=6)[:5].astype(np.int64)
        of_counts[0] = counts.size
        return pa.Table.from_batches([blocks(sums, total, at), blocks(np.arange(5, dtype=np.uint64), of_counts, np.full(5, -1))])

    return group


TOTALS = pa.schema([("bucket", pa.int64()), ("numbers", pa.list_(pa.int64()))])
TOTALS_DDL = "bucket bigint, numbers array<bigint>"


def _store_sums(path: str, starts):
    first, edges = _group_starts(starts, len(starts) - 1)

    def group(key, table):
        at = key[0].as_py()
        keys, sums = merge(table)
        if at < 0:
            return pa.table({"bucket": [at], "numbers": [sums.tolist()]}, schema=TOTALS)
        words, kinds = (keys >> np.uint64(2)).astype(np.int64), keys & np.uint64(3)
        for kind, name in enumerate(("n1", "n2", "n3", "left")):
            row = np.zeros(edges[at + 1] - edges[at] + (at == edges.size - 2), np.uint32)
            row[words[kinds == kind] - edges[at]] = sums[kinds == kind]
            for bucket in range(first[at], first[at + 1]):
                end = None if bucket == len(starts) - 2 else starts[bucket + 1] - edges[at]
                write_array(f"{path}/words/{bucket}.{name}", row[starts[bucket] - edges[at] : end])
        left = sums[kinds == 3]
        of_left = np.bincount(np.minimum(left, 5), minlength=6)[:5].astype(np.int64)
        of_left[0] = left.sum()
        return pa.table({"bucket": [at], "numbers": [of_left.tolist()]}, schema=TOTALS)

    return group


def train(texts: DataFrame, text: str = "text", buckets: int | None = None) -> Model:
    """Count a model over all texts; null texts are empty ones, and an empty table gives a model of nothing.

    ``buckets`` splits words and, four times as finely, pairs; by default as many as the
    session has shuffle partitions. There may be 2^32 - 2 distinct words.
    """
    spark = texts.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark)
    rows = texts.select(F.col(text).alias("text"))
    counted = rows.mapInArrow(_count_words(buckets), BLOCK_DDL)
    sizes = materialize(counted.groupBy("bucket").applyInArrow(_store_words(path), WORD_TOTALS_DDL)).collect()
    words, tokens, ends = np.zeros(buckets, np.int64), sum(r.tokens for r in sizes), sum(r.texts for r in sizes)
    for row in sizes:
        words[row.bucket] = row.words
    starts = tuple(int(x) for x in np.append(0, np.cumsum(words)))
    if starts[-1] >= NUMBERS - 1:
        raise ValueError(f"{starts[-1]} distinct words do not fit 32-bit numbers")
    often = [starts[r.bucket] + at for r in sizes for at, n in zip(r.top, r.top_counts) if n > tokens / (8 * buckets)]
    hot = (*sorted(often), starts[-1])
    pair_buckets = 4 * buckets
    sums = (
        rows.mapInArrow(_count_pairs(path, starts, hot, pair_buckets), BLOCK_DDL)
        .groupBy("bucket").applyInArrow(_store_pairs(path, starts), BLOCK_DDL)
    )
    totals = materialize(sums.groupBy("bucket").applyInArrow(_store_sums(path, starts), TOTALS_DDL)).collect()
    of_pairs = np.sum([r.numbers for r in totals if r.bucket < 0], axis=0, initial=0) + np.zeros(5, np.int64)
    of_left = np.sum([r.numbers for r in totals if r.bucket >= 0], axis=0, initial=0) + np.zeros(5, np.int64)
    word_discounts = discounts(*map(int, of_left[1:]))
    pairs = int(of_left[0])
    more = starts[-1] - int(of_left[1:3].sum())
    spare = float(np.dot(word_discounts, [of_left[1], of_left[2], more])) / pairs if pairs else 1.0
    return Model(
        path, starts, pair_buckets, hot, tokens=tokens, words=starts[-1], pairs=pairs, texts=ends,
        discounts=discounts(*map(int, of_pairs[1:])), word_discounts=word_discounts, left_over=spare,
    )


class Scorer:
    """Log probabilities of whole pieces of texts under a model."""

    def __init__(self, model: Model):
        self.model, self.words, self.open = model, Words(model.path, model.word_starts), {}
        self.hot = np.array(model.hot, np.uint64)

    def _bucket(self, bucket: int) -> tuple[np.ndarray, ...]:
        if bucket not in self.open:
            at = f"{self.model.path}/pairs/{bucket}"
            kinds = (("key", np.uint64), ("count", np.uint8), ("at", np.int64), ("large", np.int64))
            self.open[bucket] = tuple(map_array(f"{at}.{name}", kind) for name, kind in kinds)
        return self.open[bucket]

    def pair_counts(self, pairs: np.ndarray) -> np.ndarray:
        """Counts of distinct pairs of known words, zero where a pair is new."""
        buckets = _bucket_of_pair(pairs, self.hot, self.model.pair_buckets)
        order = np.lexsort((pairs, buckets))
        edges = np.searchsorted(buckets[order], np.arange(self.model.pair_buckets + 1))
        out = np.zeros(pairs.size, np.int64)
        for bucket in np.flatnonzero(np.diff(edges)):
            rows = order[edges[bucket] : edges[bucket + 1]]
            keys, counts, large_at, large = self._bucket(bucket)
            at = np.minimum(np.searchsorted(keys, pairs[rows]), keys.size - 1)
            found = counts[at].astype(np.int64)
            if large_at.size:
                over = found == 255
                found[over] = large[np.searchsorted(large_at, at[over])]
            out[rows] = np.where(keys[at] == pairs[rows], found, 0)
        return out

    def score(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """Per text of a piece: tokens, known tokens, base score, score."""
        m = self.model
        first, second, lengths = _pairs(batch, self.words)
        begins = np.cumsum(lengths) - lengths

        number, back = np.unique(second, return_inverse=True)
        known = number >= 0
        count, word_p = np.zeros(number.size, np.int64), np.full(number.size, m.left_over / (m.words + 1))
        count[known] = self.words.values("count", np.int64, number[known])
        left = self.words.values("left", np.uint32, number[known]).astype(np.int64)
        cut = np.array((0.0, *m.word_discounts))[np.minimum(left, 3)]
        word_p[known] += (left - cut) / max(m.pairs, 1)
        base = np.log10((count + 1) / (m.tokens + m.words + 1))

        number, back_first = np.unique(first, return_inverse=True)
        known = (number >= 0) & (number < m.words) | (number == m.words) & (m.texts > 0)
        total, rest = np.ones(number.size), np.ones(number.size)
        inner = known & (number < m.words)
        total[inner] = self.words.values("count", np.int64, number[inner])
        total[known & ~inner] = m.texts
        rest[known] = sum(
            d * self.words.values(name, np.uint32, number[known]) for d, name in zip(m.discounts, ("n1", "n2", "n3"))
        ) / total[known]

        pair, seen = np.zeros(second.size), (second >= 0) & known[back_first]
        keys, back_pair = np.unique(
            first[seen].astype(np.uint64) << np.uint64(32) | second[seen].astype(np.uint64), return_inverse=True
        )
        counts = self.pair_counts(keys)
        pair[seen] = (counts - np.array((0.0, *m.discounts))[np.minimum(counts, 3)])[back_pair]
        p = pair / total[back_first] + rest[back_first] * word_p[back]
        return {
            "n_tokens": lengths,
            "n_known": np.add.reduceat((count > 0)[back].astype(np.int64), begins),
            "base_score": np.add.reduceat(base[back], begins),
            "score": np.add.reduceat(np.log10(p), begins),
        }


def score(texts: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, n_known, train_tokens, base_score, score)`` per row, in log10.

    ``base_score`` is that of single words with one added to each count. Null texts are
    empty, i.e. the end alone; rows are not merged, and other columns do not matter.
    """

    def task(batches):
        scorer = Scorer(model)
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = scorer.score(piece)
                found["train_tokens"] = np.full(piece.num_rows, model.tokens)
                columns = [piece.column("key"), *(pa.array(found[name]) for name in names[1:])]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    ddl = f"`{key}` {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return rows.mapInArrow(task, ddl)


def perplexity(scores: DataFrame) -> DataFrame:
    """One row: perplexity per token of the model and of the base over the scored texts."""
    per_token = lambda name: F.pow(F.lit(10.0), -F.sum(name) / F.sum("n_tokens"))
    return scores.agg(per_token("score").alias("perplexity"), per_token("base_score").alias("base_perplexity"))
