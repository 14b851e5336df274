import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from wordspace.functions import vectors as V
from wordspace.operators import sums
from wordspace.space import VectorSpace

WORDS = ["a", "", "métadonnée", "漢字", "metadata", "x#1"] + [f"w{i}" for i in range(60)]


@pytest.mark.parametrize("size, k", [(1024, 8), (1000, 6), (16000, 48), (8, 8)])
def test_index_vectors_agree(spark, size, k):
    space = VectorSpace(size, k)
    rows = spark.createDataFrame([(w,) for w in WORDS], "word string")
    found = rows.select("word", V.index_vector(F.col("word"), space).alias("vec")).collect()
    dims, signs = V.index_table([r.word for r in found], size, k)
    for row, d, s in zip(found, dims, signs):
        cells = dict(zip(row.vec.dims, row.vec.vals))
        assert cells == dict(zip(d.tolist(), s.tolist())) == brute.index_vector(row.word, size, k)
        assert len(cells) == k and sum(cells.values()) == 0
        assert row.vec.dims == sorted(row.vec.dims)


def test_space_is_checked():
    for bad in ({"size": 4, "k": 6}, {"k": 3}, {"k": 0}, {"radius": -1}):
        with pytest.raises(ValueError):
            VectorSpace(**{"size": 100, "k": 4, **bad})


def test_permute(spark):
    vec = V.index_vector(F.lit("word"), VectorSpace(100, 4))
    row = spark.range(1).select(
        vec.alias("v"), V.permute(vec, 0, 100).alias("zero"), V.permute(V.permute(vec, 37, 100), -137, 100).alias("two"),
        V.permute(vec, -100, 100).alias("full"), V.permute(vec, 99, 100).alias("on"),
    ).first()
    assert row.v == row.zero == row.two == row.full
    assert dict(zip(row.on.dims, row.on.vals)) == {(d + 99) % 100: v for d, v in zip(row.v.dims, row.v.vals)}
    assert row.on.dims == sorted(row.on.dims)


def test_normalize(spark):
    rows = spark.sql(
        "SELECT named_struct('dims', array(1, 4), 'vals', array(3L, -4L)) AS v UNION ALL "
        "SELECT named_struct('dims', cast(array() AS array<int>), 'vals', cast(array() AS array<bigint>))"
    )
    found = [r.u for r in rows.select(V.normalize(F.col("v")).alias("u")).collect()]
    assert sorted((u.dims, u.vals) for u in found) == [([], []), ([1, 4], [0.6, -0.8])]


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "key string, weight bigint, factor bigint, vec struct<dims:array<int>,vals:array<bigint>>")


def test_sums_of_signed_vectors(spark):
    rows = _vectors(
        spark,
        [
            ("a", 1, 1, ([0, 2], [1, 5])), ("a", 2, -1, ([2, 3], [5, 1])), ("b", 1, 3, ([1], [2])), ("c", 4, 1, ([], [])),
            (None, 1, 1, ([1], [1])),
        ],
    )
    found = {r.key: (r.weight, r.vec.dims, r.vec.vals) for r in sums.sum_vectors(rows, 4).collect()}
    assert found == {"a": (3, [0, 3], [1, -1]), "b": (1, [1], [6]), "c": (4, [], []), None: (1, [1], [1])}


def test_a_key_of_every_task_meets_in_two_steps(spark):
    rows = _vectors(spark, [("hot", 1, 1, ([i % 4], [i])) for i in range(640)]).repartition(64)
    partial = sums.combine_local(rows, 4)
    assert partial.count() == 64
    assert sums.spread_sum(partial, 4, fan=8).count() <= 8
    # Building the plan runs nothing.
    spark.sparkContext.setJobGroup("planned", "only planned")
    sums.sum_vectors(rows.repartition("key"), 4, few=True)
    assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup("planned"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    found = {r.key: (r.weight, r.vec.vals) for r in sums.sum_vectors(rows, 4, few=True).collect()}
    assert found == {"hot": (640, [sum(range(d, 640, 4)) for d in range(4)])}


def test_sums_beyond_32_bits(spark):
    big = 1 << 40
    rows = _vectors(spark, [("a", 1, 1, ([1, 2], [big + 1, -big])), ("a", 1, 1, ([1, 2], [big, 40000]))])
    row = sums.sum_vectors(rows, 4).first()
    assert row.vec.vals == [2 * big + 1, 40000 - big]


def test_cosine(spark):
    rows = spark.sql(
        """SELECT * FROM VALUES
        (1, named_struct('dims', array(0, 2), 'vals', array(1D, 1D)), named_struct('dims', array(2), 'vals', array(5D))),
        (2, NULL, named_struct('dims', array(1), 'vals', array(5D))),
        (3, named_struct('dims', array(0), 'vals', array(1D)), named_struct('dims', array(1), 'vals', array(5D))),
        (4, named_struct('dims', array(0), 'vals', array(0D)), named_struct('dims', array(0), 'vals', array(5D)))
        AS t(id, a, b)"""
    )
    found = {r.id: r.s for r in rows.select("id", V.cosine_function(3)("a", "b").alias("s")).collect()}
    assert found[1] == pytest.approx(1 / np.sqrt(2))
    assert (found[2], found[3], found[4]) == (None, 0.0, None)


def test_digests_of_words_of_any_length():
    from hashlib import md5

    from wordspace.functions.vectors import _numbered_digests

    names = [("é" * n)[:n].encode() for n in range(0, 40)] + [b"x" * n for n in range(45, 140)] + [b"", b"\0", b"\x80#"] + [str(i).encode() for i in range(9000)]
    for k in (2, 12, 102):
        found = _numbered_digests(names[: 200 if k > 2 else None], k)
        for name, row in zip(names, found):
            for i in (0, 1, k // 2, k - 1):
                digest = md5(name + f"#{i}".encode()).digest()
                assert row[i].tolist() == [int.from_bytes(digest[:4]), int.from_bytes(digest[4:8])]
