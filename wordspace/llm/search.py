"""Ranked lexical search with equal bags scored once.

Every document is restricted to the words of the items: what is left of it is a bag of
``(term, tf)`` and its length factor ``m``. Documents that agree in both have the same score
for every item, so they form a class, found by a hash of bag and factor and verified by the
bag itself. A class is scored once against all items, and its members follow by ascending id.

All items go past the documents in blocks of bounded size; a term that an item has adds to the
item's score in one pass over the inverted lists of the block. Of a class, as of an item, only as many
rows can be in a result as the result has ranks, and Spark's limit within groups applies that before and
after the shuffle: a class with a third of all documents costs each task a few rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordspace.llm.tokens import word_lists
from wordspace.sources.scratch import materialize

#: Ranks of an item.
TOP = 10
# How much of the length of a document counts, in per cent.
SLOPE = 90
#: Most terms of items, and items, of a block (one item of more terms is a block of its own).
BLOCK_TERMS, BLOCK_ITEMS = 1 << 18, 1 << 11
#: Cells of a task's table of classes by items.
CELLS = 1 << 20


def wordings(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, terms, n)`` per item: its distinct terms in order, joined by spaces, and their number."""
    kind = items.schema[item].dataType.simpleString()

    def task(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                found: set[bytes] = set()
                for words in word_lists(value.as_py()):
                    found.update(words)
                rows.append((b" ".join(sorted(found)), len(found)))
            terms, n = zip(*rows) if rows else ((), ())
            columns = [batch.column(0), pa.array(terms, pa.binary()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "terms", "n"])

    rows = items.select(F.col(item).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(task, f"item {kind}, terms binary, n bigint")


def item_blocks(distinct: DataFrame, terms: int = BLOCK_TERMS, items: int = BLOCK_ITEMS) -> tuple[DataFrame, int]:
    """The rows ``(code, terms, n)`` dealt by hash to blocks within both bounds, and the number of blocks.

    A block beyond the bounds holds a single row.
    """
    blocks = 1
    while True:
        dealt = distinct.withColumn("block", F.pmod(F.xxhash64("terms"), F.lit(blocks)).cast("int"))
        sizes = dealt.groupBy("block").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
        if sizes.filter((F.col("rows") > 1) & ((F.col("n") > terms) | (F.col("rows") > items))).isEmpty():
            return dealt, blocks
        blocks *= 2


def bags(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n, bag)``: number of terms with repeats, and those of the vocabulary as packed ``(term, tf)``."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches):
        number = shared.value
        for batch in batches:
            rows = []
            for value in batch.column(1):
                n, found = 0, Counter()
                for words in word_lists(value.as_py()):
                    n += len(words)
                    found.update(filter(number.__contains__, words))
                bag = np.array(sorted((number[word], tf) for word, tf in found.items()), np.int32)
                rows.append((n, bag.tobytes()))
            n, packed = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], ["key", "n", "bag"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(task, f"key {kind}, n bigint, bag binary")


def _cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and tf of every cell of packed bags."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False) // 8
    cells = np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(column)), size), cells[:, 0], cells[:, 1]


def document_frequencies(bagged: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each of ``terms`` terms is; a task hands on one row per term it met."""

    def task(batches):
        counts = np.zeros(terms, np.int64)
        for batch in batches:
            counts += np.bincount(_cells(batch.column(0))[1], minlength=terms)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met])], ["term", "df"])

    out = np.zeros(terms, np.int64)
    for row in bagged.select("bag").mapInArrow(task, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row.term] = row.df
    return out


def classes(bagged: DataFrame, documents: int, length: int, top: int = TOP) -> DataFrame:
    """``(m, bag, members)``: documents alike in bag and length factor, the first ``top`` by id.

    Rows with no term of the items are in no class, as their score is 0.
    """
    share = F.expr(f"{SLOPE}L * n * {documents}L div {length}L")
    rows = bagged.filter(F.length("bag") > 0).select("key", (share + (100 - SLOPE)).alias("m"), "bag")
    rows = rows.withColumn("hash", F.xxhash64("bag", "m"))
    alike = ["hash", "m", "bag"]
    first = F.row_number().over(Window.partitionBy(*alike).orderBy(F.asc_nulls_last("key")))
    few = rows.withColumn("place", first).filter(F.col("place") <= top)
    # Nulls of the key would be left out of a plain list.
    members = F.array_sort(F.collect_list(F.struct("place", "key")))
    return few.groupBy(*alike).agg(F.transform(members, lambda one: one["key"]).alias("members")).select("m", "bag", "members")


def class_scores(found: DataFrame, weights: np.ndarray, lists: list[list[int]], items: int, top: int = TOP) -> DataFrame:
    """``(item, score, members)``: for each item the classes that can be among its best, from every task.

    ``lists`` holds the items of each term. A task remembers the lowest of the best scores it
    has handed on for each item, and hands on no class below that.
    """
    kind = found.schema["members"].dataType.simpleString()
    edges = np.concatenate(([0], np.cumsum([len(one) for one in lists]))).astype(np.int64)
    members_of = np.array([item for one in lists for item in one], np.int64)
    shared = found.sparkSession.sparkContext.broadcast((weights, edges, members_of))
    rows_at_once = max(top, CELLS // max(items, 1))

    def task(batches):
        weights, edges, members_of = shared.value
        floor = np.ones(items, np.int64)
        for whole in batches:
            for begin in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(begin, rows_at_once)
                first = pc.list_element(batch.column("members"), 0)
                batch = batch.take(pc.sort_indices(first, null_placement="at_end"))
                row, term, tf = _cells(batch.column("bag"))
                m = batch.column("m").to_numpy()[row]
                parts = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                size = edges[term + 1] - edges[term]
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                scores = np.zeros(batch.num_rows * items, np.int64)
                np.add.at(scores, np.repeat(row * items, size) + members_of[np.repeat(edges[term], size) + step], np.repeat(parts, size))
                scores = scores.reshape(batch.num_rows, items)
                # Equal scores stay in the order of the ids.
                best = np.argsort(-scores, axis=0, kind="stable")[:top]
                held = np.take_along_axis(scores, best, axis=0)
                place, item = np.nonzero(held >= floor)
                if len(best) == top:
                    floor = np.maximum(floor, held[-1])
                if place.size:
                    columns = [pa.array(item.astype(np.int32)), pa.array(held[place, item]), batch.column("members").take(pa.array(best[place, item]))]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "score", "members"])

    return found.mapInArrow(task, f"item int, score bigint, members {kind}")


def _best(rows: DataFrame, by: list, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), *by))
    return rows.withColumn("rank", place).filter(F.col("rank") <= top)


def _block_ranks(docs, rows, totals, key, text, top):
    """``(code, rank, key, score)`` for the items of one block, a list of ``(code, terms)``."""
    vocabulary: dict[bytes, int] = {}
    lists: list[list[int]] = []
    for number, row in enumerate(rows):
        for word in bytes(row.terms).split():
            if vocabulary.setdefault(word, len(lists)) == len(lists):
                lists.append([])
            lists[vocabulary[word]].append(number)
    bagged = materialize(bags(docs, vocabulary, key, text))
    if not totals:
        some = F.coalesce(F.sum("n"), F.lit(0))
        totals.extend(bagged.agg(F.count_if(F.col("n") > 0), some).first())
    documents, length = totals
    if not length or not lists:
        return None
    found = document_frequencies(bagged, len(lists))
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in found], np.int64)
    scores = class_scores(classes(bagged, documents, length, top), weights, lists, len(rows), top)
    first = F.asc_nulls_last(F.element_at("members", 1))
    members = _best(scores, [first], top).select("item", "score", F.explode("members").alias("key"))
    ranked = _best(members, [F.asc_nulls_last("key")], top)
    codes = docs.sparkSession.createDataFrame([(number, row.code) for number, row in enumerate(rows)], "item int, code bigint")
    return ranked.join(F.broadcast(codes), "item").select("code", "rank", "key", "score")


def search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    top: int = TOP, block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """``(item, rank, key, score)``: the ``top`` documents of the highest scores above 0 for every item.

    Equal scores rank by ascending id, a null id last. Null and empty texts have no terms: such
    a document counts for nothing, such an item has no rows. Repeated rows of documents are
    documents of their own; repeated items get the same rows each.
    """
    spark = docs.sparkSession
    asked = materialize(wordings(items, item, item_text).filter("n > 0"))
    distinct = materialize(asked.select("terms", "n").distinct().withColumn("code", F.monotonically_increasing_id()))
    dealt, blocks = item_blocks(distinct, block_terms, block_items)
    out, totals = None, []
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).orderBy("code").collect()
        ranked = _block_ranks(docs, rows, totals, key, text, top) if rows else None
        if ranked is not None:
            out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        kind = docs.schema[key].dataType.simpleString()
        out = spark.createDataFrame([], f"code bigint, rank int, key {kind}, score bigint")
    named = asked.join(distinct.select("terms", "code"), "terms").select("item", "code")
    return named.join(out, "code").select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
