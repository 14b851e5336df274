"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordspace.sources.scratch import materialize


def _roots(labels: DataFrame) -> DataFrame:
    """The label of the label, and so on, of each ``(node, label)``; every label is a node."""
    while True:
        of = labels.select(F.col("node").alias("n"), F.col("label").alias("l"))
        stepped = materialize(labels.join(of, F.col("label") == F.col("n")).select("node", "label", F.col("l").alias("next")))
        labels = stepped.select("node", F.col("next").alias("label"))
        if stepped.filter("next < label").isEmpty():
            return labels


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, label)``: each linked node with the smallest node of its component.

    Each round every node points to its smallest neighbour, if smaller, and the trees of pointers
    become one node each. What is left of the links are those between trees, of which there are at most half as
    many as nodes; so a link is joined in the rounds it takes to be inside of a tree, one for the links of a star.
    """
    edges, rounds = materialize(links.select(F.col(left).alias("a"), F.col(right).alias("b"))), []
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        both = both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other")))
        labels = _roots(materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"))))
        rounds.append(labels)
        for end in ("a", "b"):
            named = labels.select(F.col("node").alias("n"), F.col("label").alias("l"))
            edges = edges.join(named, F.col(end) == F.col("n")).drop("n", end).withColumnRenamed("l", end)
        edges = materialize(edges.filter("a <> b").select("a", "b").distinct())
        if edges.isEmpty():
            break
    found = rounds.pop()
    for labels in reversed(rounds):
        later = found.select(F.col("node").alias("n"), F.col("label").alias("l"))
        found = labels.join(later, F.col("label") == F.col("n"), "left").select("node", F.coalesce("l", "label").alias("label"))
    return materialize(found) if rounds else found
