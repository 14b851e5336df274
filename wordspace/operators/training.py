"""Training word vectors from texts and merging them into a lexicon.

A lexicon is ``(key, vec)``, one row per word. A trainer is any function that turns
texts into the packed partial rows of :func:`wordspace.operators.sums.pack`; the three of this module are the ones
the commands use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordspace.functions.text import each, sentence_array, token_array
from wordspace.operators.contexts import DEALT_DDL, add_contexts, deal_contexts
from wordspace.operators.sums import merge_by_key, pack
from wordspace.space import INT_VECTOR, VectorSpace

Trainer = Callable[[DataFrame, VectorSpace], DataFrame]


def _contexts(token_rows: DataFrame, space: VectorSpace, ordered: bool) -> DataFrame:
    """Rows by word that :func:`merge_lexicon` adds up: partial vectors, or the tokens a word stands among."""
    return token_rows.mapInArrow(deal_contexts(space, ordered), DEALT_DDL)


def from_sentences(docs: DataFrame, space: VectorSpace, text: str = "text") -> DataFrame:
    """Every token sees its whole sentence, each neighbour turned by its distance."""
    parts = each(docs, sentence_array(F.col(text)), "sentence")
    return from_lines(parts, space, "sentence")


def from_lines(lines: DataFrame, space: VectorSpace, line: str = "value") -> DataFrame:
    """As :func:`from_sentences` for rows that hold one sentence each."""
    rows = lines.filter(F.col(line).isNotNull()).select(token_array(F.col(line)).alias("tokens"))
    return _contexts(rows, space, ordered=True)


def from_windows(docs: DataFrame, space: VectorSpace, text: str = "text") -> DataFrame:
    """Every token sees the tokens within the radius, across the whole document."""
    rows = docs.filter(F.col(text).isNotNull())
    return _contexts(rows.select(token_array(F.col(text)).alias("tokens")), space, ordered=False)


def empty_lexicon(spark) -> DataFrame:
    return spark.createDataFrame([], f"key string, vec {INT_VECTOR}")


def merge_lexicon(
    lexicon: DataFrame | None, partial: DataFrame, space: VectorSpace, partitions: int | None = None
) -> DataFrame:
    """Add trained vectors onto a lexicon: words of either side stay, shared ones add up.

    A full outer join by word with the sums taken on the way, for the price of the one
    shuffle the sums need anyway. Other columns of the lexicon, if it has any, are joined to
    the sums afterwards: of each the first value of a word that is not null.
    """
    if lexicon is not None:
        stored = lexicon.select("key", F.lit(0).cast("bigint").alias("weight"), "vec")
        stored = pack(stored, space.size)
        partial = partial.unionByName(stored, allowMissingColumns=True)
    if "tokens" in partial.columns:
        # All rows of a word meet and are sorted as they are; vectors are only made of them after that.
        met = partial.repartition(*([partitions] if partitions else []), "key").sortWithinPartitions("key")
        merged = met.mapInArrow(add_contexts(space), f"key string, weight bigint, vec {INT_VECTOR}").select("key", "vec")
    else:
        merged = merge_by_key(partial, space.size, partitions=partitions).select("key", "vec")
    others = [] if lexicon is None else [c for c in lexicon.columns if c not in ("key", "vec")]
    if not others:
        return merged
    kept = lexicon.groupBy(F.col("key").alias("stored_key")).agg(*(F.first(c, ignorenulls=True).alias(c) for c in others))
    return merged.join(kept, merged["key"].eqNullSafe(kept["stored_key"]), "left").select("key", "vec", *others)


def train(
    texts: DataFrame, space: VectorSpace, trainer: Trainer = from_sentences, lexicon: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """The lexicon after training on the texts, on top of an earlier one if given."""
    return merge_lexicon(lexicon, trainer(texts, space), space, partitions)
