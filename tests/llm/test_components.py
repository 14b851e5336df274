"""Connected components against a plain search."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wordspace.llm import components as module
from wordspace.llm.near_dedup import _near


def plain(pairs):
    label = {node: node for pair in pairs for node in pair}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    numbers = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(i, i) for i in (200, 201)]
    pairs += [(300 + numbers.randrange(60), 300 + numbers.randrange(60)) for _ in range(45)] + [(9, 5), (9, 5)]
    numbers.shuffle(pairs)
    found = module.components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert {r.node: r.label for r in found.collect()} == plain(pairs)
    assert module.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_links_of_a_star_are_joined_once(spark, monkeypatch):
    """Links inside of a tree are gone after the round that finds it."""
    rows = []
    real = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: rows.append((df.columns, (out := real(df)).count())) or out)
    links = spark.range(1, 400).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    module.components(links)
    assert [n for columns, n in rows if columns == ["a", "b"]] == [399, 0]


def test_blocks_name_the_smallest_id():
    ids = pa.chunked_array([pa.array(["d", "a", "c", "b", "e"])])
    found = _near(ids, [np.array([0, 2])], [np.array([2, 3])]).to_pylist()
    assert found == [{"a": "d", "b": "b", "n": 1}, {"a": "c", "b": "b", "n": 2}, {"a": "b", "b": "b", "n": 1}]
