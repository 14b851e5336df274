import random

from pyspark.sql import functions as F

import brute
from test_training import docs, random_texts
from wordspace.operators import similarity, windows


def test_offsets(spark):
    row = spark.range(1).select(windows.offsets(2).alias("two"), windows.offsets(0).alias("none")).first()
    assert row.two == [-2, -1, 1, 2] and row.none == []


def test_context_windows(spark):
    texts = random_texts(9, 10) + ["", "solo"]
    found = {(r.doc_id, r.pos): (r.word, r.context) for r in windows.context_windows(docs(spark, texts), 3).collect()}
    expected = {}
    for i, text in enumerate(texts):
        words = brute.tokens(text)
        for at, word in enumerate(words):
            expected[i, at] = (word, words[max(0, at - 3) : at] + words[at + 1 : at + 4])
    assert found == expected


def test_context_windows_need_no_shuffle(spark):
    plan = windows.context_windows(spark.range(3).selectExpr("id AS doc_id", "cast(id AS string) AS text"), 3)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_seeded_order(spark):
    rows = spark.range(100)
    once = [r.id for r in windows.seeded_order(rows, "id", 1).collect()]
    assert once == [r.id for r in windows.seeded_order(rows.repartition(7), "id", 1).collect()]
    assert sorted(once) == list(range(100)) != once
    assert once != [r.id for r in windows.seeded_order(rows, "id", 2).collect()]


def test_seeded_numbers(spark):
    found = [r.id for r in windows.seeded_numbers(spark, 50, 20, 3).collect()]
    assert len(set(found)) == 20 and set(found) <= set(range(50))
    assert sorted(r.id for r in windows.seeded_numbers(spark, 5, 9, 3).collect()) == list(range(5))


def test_shuffled_arrays(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4, 5, 5],), ([],)], "v array<int>")
    found = [r.s for r in rows.select(windows.shuffle_array(F.col("v"), 4).alias("s")).collect()]
    assert sorted(found[0]) == [1, 2, 3, 4, 5, 5] and found[1] == []


def test_ranges(spark):
    assert [r.id for r in windows.number_range(spark, 2, 9, 3).collect()] == [2, 5, 8]


def test_numbers_per_row(spark):
    rows = spark.createDataFrame([(7,), (0,), (2,)], "n int")
    found = rows.select("n", windows.steps(F.lit(1), F.col("n"), 3).alias("s"), windows.seeded_picks(F.col("n"), 4, 3).alias("p")).collect()
    assert {r.n: r.s for r in found} == {7: [1, 4], 0: [], 2: [1]}
    for r in found:
        assert len(set(r.p)) == len(r.p) == min(4, r.n) and set(r.p) <= set(range(r.n))


def test_top_by(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.randint(0, 5))) for i in range(40)] + [(99, None)]
    best = similarity.top_by(spark.createDataFrame(rows, "id int, v double"), 7, "v", "id").collect()
    assert [r.id for r in best] == [i for i, v in sorted(rows[:-1], key=lambda r: (-r[1], r[0]))[:7]]


def test_seeded_numbers_permute_the_range(spark):
    for bound in (1, 2, 3, 5, 17, 64, 1000):
        rows = windows.seeded_numbers(spark, bound, bound + 5, 3).orderBy("nth").collect()
        assert sorted(r.id for r in rows) == list(range(bound)) and [r.nth for r in rows] == list(range(bound))
        assert windows.seeded_numbers(spark, bound, bound // 2, 3).orderBy("nth").collect() == rows[: bound // 2]
    wide = windows.seeded_numbers(spark, 1 << 61, 500, 3)
    assert wide.select("id").distinct().count() == 500 and wide.filter("id < 0 OR id >= 2305843009213693952").count() == 0
    assert wide.agg({"id": "avg"}).first()[0] > 1 << 58
    assert windows.seeded_numbers(spark, 1000, 9, 4).collect() != windows.seeded_numbers(spark, 1000, 9, 3).collect()
    assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()
    assert windows.seeded_numbers(spark, 0, 5, 3).count() == 0
