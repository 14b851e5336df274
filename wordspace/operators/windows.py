"""Context windows, ranges and seeded orders as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordspace.functions.text import token_array


def offsets(radius: int) -> Column:
    """The offsets ``-radius .. radius`` without the centre."""
    return F.filter(F.sequence(F.lit(-radius), F.lit(radius)), lambda o: o != 0)


def context_windows(docs: DataFrame, radius: int, doc="doc_id", text: str = "text") -> DataFrame:
    """``(doc.., pos, word, context)``: the words around each token, nearest edge cut off.

    The words of a text sit in one row already, so the windows need neither a shuffle
    nor a sort.
    """
    names = [doc] if isinstance(doc, str) else list(doc)
    words = docs.select(*names, token_array(F.col(text)).alias("words"))

    def window(word: Column, i: Column) -> Column:
        around = F.transform(offsets(radius), lambda o: F.get(F.col("words"), i + o))
        return F.struct(
            i.alias("pos"), word.alias("word"), F.filter(around, lambda w: w.isNotNull()).alias("context")
        )

    return words.select(*names, F.inline(F.transform("words", window)))


def number_range(spark: SparkSession, start: int, end: int, step: int = 1) -> DataFrame:
    """``(id)`` from ``start`` up to, but without, ``end``."""
    return spark.range(start, end, step)


def steps(start: Column, end: Column, step: int = 1) -> Column:
    """The numbers from ``start`` up to, but without, ``end``, as an array per row."""
    return F.when(start < end, F.sequence(start, end - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _shuffle_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit("#"), F.lit(str(seed))))


def seeded_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """The rows in an order fixed by the seed; a range-partitioned sort."""
    return rows.orderBy(_shuffle_key(F.col(key), seed), key)


def shuffle_array(values: Column, seed: int) -> Column:
    """The elements of an array in an order fixed by the seed and the length."""
    tagged = F.transform(
        values, lambda v, i: F.struct(_shuffle_key(i, seed).alias("at"), i.alias("i"), v.alias("v"))
    )
    return F.transform(F.array_sort(tagged), lambda t: t["v"])


def seeded_picks(bound: Column, num: int, seed: int) -> Column:
    """``num`` distinct numbers below ``bound``, or all there are, in seeded order, as an array per row."""
    return F.slice(shuffle_array(steps(F.lit(0), bound), seed), 1, num)


# Rounds of the permutation, and most times a number is permuted: each time it stays beyond the bound with
# a probability of three quarters at most.
_ROUNDS, _WALK = 4, 512


def seeded_number(nth: Column, bound: int, seed: int) -> Column:
    """The ``nth`` number of a seeded order of the numbers below ``bound``, found without the others.

    A keyed permutation of the numbers of an even count of bits (four rounds that swap halves and
    mix one into the other) is applied until the number is below the bound, which permutes those.
    """
    if not 0 < bound <= 1 << 62:
        raise ValueError(f"the bound has to be from 1 to 2^62, got {bound}")
    half = max(1, ((bound - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def mixed(right: Column, step: int) -> Column:
        digest = F.md5(F.concat(right.cast("string"), F.lit(f"#{seed}#{step}")))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").bitwiseAND(mask)

    def turned(step: int):
        return lambda pair: F.struct(pair["r"].alias("l"), pair["l"].bitwiseXOR(mixed(pair["r"], step)).alias("r"))

    def permuted(x: Column) -> Column:
        # A one-element transform names each state, so that it is computed once.
        state = F.array(F.struct(F.shiftright(x, half).alias("l"), x.bitwiseAND(mask).alias("r")))
        for step in range(_ROUNDS):
            state = F.transform(state, turned(step))
        return F.get(F.transform(state, lambda p: F.shiftleft(p["l"], half).bitwiseOR(p["r"])), F.lit(0))

    walk = F.sequence(F.lit(1), F.lit(_WALK))
    found = F.aggregate(walk, permuted(nth.cast("bigint")), lambda x, _: F.when(x < bound, x).otherwise(permuted(x)))
    return F.when(found < bound, found).otherwise(F.raise_error(F.lit("no number below the bound was met")))


def seeded_numbers(spark: SparkSession, bound: int, num: int, seed: int) -> DataFrame:
    """``(nth, id)``: ``num`` distinct numbers below ``bound``, or all there are, in seeded order.

    Each row finds its own number, so nothing is ranked and nothing is shuffled.
    """
    rows = spark.range(max(0, min(num, bound))).withColumnRenamed("id", "nth")
    return rows.withColumn("id", seeded_number(F.col("nth"), max(bound, 1), seed))
