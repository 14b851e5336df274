"""Ranked search against plain Python, one document at a time."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordspace.llm import search

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = bytes(range(65, 91))


def terms(text):
    return [w.translate(bytes.maketrans(UPPER, UPPER.lower())) for w in WORD.findall((text or "").encode())]


def plain_search(docs, items, top=10):
    bags = [(key, Counter(terms(text))) for key, text in docs]
    bags = [(key, bag) for key, bag in bags if bag]
    count, length = len(bags), sum(bag.total() for _, bag in bags)
    df = Counter(word for _, bag in bags for word in bag)
    out = []
    for item, text in items:
        found = []
        for key, bag in bags:
            m = 100 - 90 + 90 * bag.total() * count // length
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * (1000000000 * bag[w] // (1000 * bag[w] + 8 * m))
                for w in set(terms(text)) if bag[w]
            )
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")


ODD = [None, "", "\n ", "Zulu zulu ZULU", "é-É", "a.b.c", "x" * 300]


@pytest.mark.parametrize("blocks", [(1 << 18, 1 << 11), (8, 6)])
def test_against_plain_python(spark, blocks):
    random.seed(3)
    words = ["the", "of", "Alpha", "beta", "gamma", "é", "zulu", "w1", "w2", "w3", "w4", "rare"]
    weights = [30, 20, 5, 4, 3, 2, 1, 2, 2, 2, 2, 0.2]
    docs = [(i, " ".join(random.choices(words, weights, k=random.randrange(40)))) for i in range(300)]
    docs += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "rare alpha"), (2000, "rare alpha")]
    items = [(i, " ".join(random.choices(words + ["unknown"], k=random.randrange(1, 9)))) for i in range(12)]
    items += [(100 + i, t) for i, t in enumerate(ODD)] + [(7, "alpha rare"), (None, "rare ALPHA"), (200, "rare Alpha")]
    got = search.search(*tables(spark, docs, items), block_terms=blocks[0], block_items=blocks[1])
    assert found(got) == plain_search(docs, items)


def test_copies_share_a_class_and_rank_by_id(spark):
    docs = [(i, "common words here and alpha") for i in range(500, 0, -1)] + [(900, "Alpha and here words common"), (901, "alpha"), (3, "beta")]
    items = [(1, "alpha"), (2, "beta gamma")]
    made = tables(spark, docs, items)
    assert found(search.search(*made)) == plain_search(docs, items)
    bagged = search.bags(made[0], {b"alpha": 0, b"beta": 1})
    groups = search.classes(bagged, 503, 2507).collect()
    assert sorted(len(g.members) for g in groups) == [1, 1, 10]
    assert list(range(1, 11)) in [g.members for g in groups]


def test_no_class_meets_whole(spark):
    docs = spark.range(1000).select("id", F.lit("alpha beta").alias("text")).repartition(16)
    plan = search.classes(search.bags(docs, {b"alpha": 0}, key="id"), 1000, 2000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_repeated_rows_other_columns_and_long_texts(spark):
    docs = [(5, "alpha beta"), (5, "alpha beta"), (6, "beta " * 400_000 + "alpha")]
    items = [(1, "alpha"), (1, "alpha beta")]
    made = [t.select("*", *(F.lit("?").alias(n) for n in ("key", "bag", "score", "code", "hash", "m", "item"))) for t in tables(spark, docs, items)]
    assert found(search.search(*made)) == plain_search(docs, items)


def test_empty_tables(spark):
    docs, items = tables(spark, [(1, "alpha")], [(1, "alpha")])
    assert search.search(docs.filter("doc_id < 0"), items).collect() == []
    assert search.search(docs, items.filter("item_id < 0")).collect() == []
    assert search.search(docs.withColumn("text", F.lit("..")), items).collect() == []
