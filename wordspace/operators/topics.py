"""Topic lexicons: a vector per topic name, and the closest topics of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordspace.functions.text import each, token_array
from wordspace.operators.documents import common_vectors, text_vectors
from wordspace.operators.similarity import all_similarities
from wordspace.operators.sums import merge_by_key, pack, sum_vectors
from wordspace.sources.scratch import materialize
from wordspace.space import VectorSpace

# Fixed value: number of topics assigned to a text.
TOPICS_PER_TEXT = 10

# Sets of topics up to which every task may hold, and send, a sum of each.
FEW_SETS = 512


def topic_vectors(docs: DataFrame, lexicon: DataFrame, space: VectorSpace) -> DataFrame:
    """``(key, weight, vec)`` per topic of ``(topics, body)`` documents.

    The document vector of a body goes to every topic named, as often as it is named, which
    makes a topic the vector of all its bodies together. Bodies of the same topics are added up first, so a
    body is worked on once however many topics it has, and what is repeated per topic
    is one vector per set of topics. A few sets have their words counted first, so that vectors stay where words meet them;
    many are dealt to blocks as texts are.
    """
    names = docs.select(F.array_sort(token_array(F.col("topics"))).alias("names"), "body").filter(F.size("names") > 0)
    named = names.withColumn("set", F.array_join("names", " "))
    few = named.select("set").distinct().limit(FEW_SETS + 1).count() <= FEW_SETS
    sets = (common_vectors if few else text_vectors)(named, lexicon, space, key="set", text="body")
    # Names are tokens, so a space never stands inside of one.
    each_topic = each(sets, F.split("key", " "), "topic", "weight", "vec").withColumnRenamed("topic", "key")
    return sum_vectors(each_topic, space.size, real=True, few=True)


def merge_topics(topics: DataFrame | None, trained: DataFrame, space: VectorSpace) -> DataFrame:
    """Add trained topic vectors onto a topic lexicon."""
    columns = ["key", "weight", "vec"]
    rows = trained.select(*columns)
    if topics is not None:
        rows = rows.unionByName(topics.select(*columns))
    return merge_by_key(pack(rows, space.size), space.size, real=True)


def assign_topics(
    vectors: DataFrame, topics: DataFrame, space: VectorSpace,
    top: int = TOPICS_PER_TEXT, ascending: bool = False,
) -> DataFrame:
    """``(left_key, right_key, similarity, rank)``: the closest topics of every text vector."""
    return all_similarities(materialize(vectors), materialize(topics), space, top, ascending)
