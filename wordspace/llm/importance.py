"""Documents drawn by importance so that they resemble a target collection (Xie et al. 2023).

A text is its bag of hashed runs of one and two words. A bucket's gain is the logarithm of how
much more often the targets fall into it than the documents do, a document's weight the mean
gain of its features, and a draw without replacement takes the largest weights after adding
Gumbel noise fixed by the id.

Bytes are translated and split to words; the checksum of a run seeds that of the next longer
run. Each task adds its features up in one counter of at most ``buckets`` keys, and the
counters meet in one small shuffle. The second pass over the texts carries the table of gains
along, whose size is that of the buckets. Ranks come from a range-partitioned sort of narrow
rows; no row is alone responsible for more than its own partition.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordspace.llm.tokens import SLICE, word_lists
from wordspace.sources.scratch import materialize

BUCKETS, LONGEST = 10_000, 2
#: Of the documents of so many words at least, so many per cent are drawn.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7
#: Gains, weights and scores are whole thousandths.
UNIT = 1000


def run_checksums(text: str | None, longest: int = LONGEST, size: int = SLICE) -> Iterator[tuple[int, list[int]]]:
    """For each slice of a text: its words, and the checksums of the runs of words that end in it."""
    held: list[bytes] = []
    for words in word_lists(text, size):
        tokens = held + words
        spaced = [b" " + word for word in tokens]
        seeds, out = list(map(crc32, tokens)), []
        for length in range(1, longest + 1):
            # Runs within the words held over were counted before.
            out += seeds[max(0, len(held) - length + 1) :]
            seeds = list(map(crc32, spaced[length:], seeds))
        yield len(words), out
        held = tokens[max(0, len(tokens) - longest + 1) :] if longest > 1 else []


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``(bucket, n)``: how many features of all texts fall into each bucket that has any."""

    def task(batches):
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                for _, sums in run_checksums(value.as_py(), longest):
                    counts.update([c % buckets for c in sums])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["bucket", "n"]
        )

    return texts.select(F.col(text).alias("text")).mapInArrow(task, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _counted(texts: DataFrame, text: str, buckets: int, longest: int) -> list[int]:
    out = [0] * buckets
    for row in bucket_counts(texts, text, buckets, longest).collect():
        out[row.bucket] = row.n
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """The gain of each bucket from its counts in the documents and in the targets."""
    many, s_all, t_all = len(source), float(sum(source)), float(sum(target))
    return np.array(
        [math.floor(UNIT * math.log((t + 1.0) * (s_all + many) / ((s + 1.0) * (t_all + many)))) for s, t in zip(source, target)], np.int64
    )


def weights(docs: DataFrame, table: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """``(key, n_words, n_features, weight)`` per row; the weight is the floored mean gain, 0 without features."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def task(batches):
        table = shared.value
        for batch in batches:
            rows = []
            for value in batch.column(1):
                words = features = total = 0
                for some, sums in run_checksums(value.as_py(), longest):
                    words, features = words + some, features + len(sums)
                    total += int(table[np.array(sums, np.int64) % table.size].sum())
                rows.append((words, features, total // features if features else 0))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([],) * 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(task, f"key {kind}, n_words bigint, n_features bigint, weight bigint")


def with_ranks(rows: DataFrame, *order) -> DataFrame:
    """The rows with their ``rank`` from 1 in the given order, which has to tell all of them apart.

    The order is that of a range-partitioned sort, written with the place in each partition;
    the driver sees one number of rows per partition.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = materialize(placed).withColumn("part", F.shiftright("place", 33))
    before, done = [], 0
    for row in placed.groupBy("part").count().orderBy("part").collect():
        before.append((row.part, done))
        done += row["count"]
    starts = rows.sparkSession.createDataFrame(before, "part bigint, before bigint")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(starts), "part").withColumn("rank", rank).drop("part", "place", "before")


def resample(
    docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST,
) -> DataFrame:
    """``(key, n_features, weight, score, rank)`` per row of ``docs``; ``rank`` is null for rows not drawn.

    Null and empty texts have no features and weight 0. A null id has the noise of the empty
    text and comes first among equal scores. Repeated rows stay apart, each a document of its
    own. Without targets, or without documents, the counts are zero and the formula holds.
    """
    table = gains(_counted(docs, text, buckets, longest), _counted(targets, target_text, buckets, longest))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-float(UNIT) * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    scored = weights(docs, table, key, text, longest).withColumn("score", F.col("weight") + noise)
    # Written once; the row number tells repeated rows apart.
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()))
    eligible = F.col("n_words") >= least_words
    wanted = percent * scored.filter(eligible).count() // 100
    ranked = with_ranks(scored.filter(eligible), F.desc("score"), F.asc("key"), F.asc("row"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.filter(~eligible).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
