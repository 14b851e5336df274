import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from wordspace.operators import contexts, partial, training
from wordspace.space import VectorSpace

SPACE = VectorSpace(64, 4, 2)
TEXTS = [
    "the cat sat on the mat\nthe dog sat",
    "solo",
    "",
    " leading and trailing \n\n blank lines\r\nhere\tand there ",
    "metadata is a word like any metadata",
    "solo\nagain solo solo",
]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def lines_of(texts):
    return [s for t in texts for s in brute.sentences(t or "")]


def random_texts(seed, n=40, hot="hot"):
    """Texts whose most frequent word holds a third of all tokens."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]

    def sentence():
        return " ".join(hot if rng.random() < 1 / 3 else rng.choice(words) for _ in range(rng.randint(1, 30)))

    return ["\n".join(sentence() for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.mark.parametrize("texts", [TEXTS, random_texts(1)], ids=["edges", "hot word"])
def test_sentences(spark, texts):
    found = brute.as_dict(training.train(docs(spark, texts), SPACE))
    assert found == brute.ordered(lines_of(texts), SPACE)


@pytest.mark.parametrize("texts", [TEXTS, random_texts(2)], ids=["edges", "hot word"])
def test_windows(spark, texts):
    found = brute.as_dict(training.train(docs(spark, texts), SPACE, training.from_windows))
    assert found == brute.windowed(texts, SPACE)


@pytest.mark.parametrize("trainer", [training.from_sentences, training.from_windows])
def test_dims_beyond_two_bytes(spark, trainer):
    wide, texts = VectorSpace(70_000, 6, 2), random_texts(10, 6) + TEXTS
    expected = brute.ordered(lines_of(texts), wide) if trainer is training.from_sentences else brute.windowed(texts, wide)
    first = training.train(docs(spark, texts[:4]), wide, trainer)
    assert brute.as_dict(training.train(docs(spark, texts[4:]), wide, trainer, first)) == expected


def test_lines(spark):
    lines = lines_of(TEXTS)
    rows = spark.createDataFrame([(s,) for s in lines] + [(None,)], "value string")
    assert brute.as_dict(training.train(rows, SPACE, training.from_lines)) == brute.ordered(lines, SPACE)


def test_one_token_sentence_keeps_its_word(spark):
    found = brute.as_dict(training.train(docs(spark, ["solo"]), SPACE))
    assert found == {"solo": {}}


def test_null_and_empty_texts(spark):
    assert training.train(docs(spark, [None, "", " \n "]), SPACE).count() == 0


@pytest.mark.parametrize("trainer", [training.from_sentences, training.from_windows])
def test_merging_batches_is_training_on_all(spark, trainer):
    one, two = random_texts(3, 15), random_texts(4, 15, hot="other")
    first = training.train(docs(spark, one), SPACE, trainer)
    merged = training.train(docs(spark, two), SPACE, trainer, first)
    assert brute.as_dict(merged) == brute.as_dict(training.train(docs(spark, one + two), SPACE, trainer))


def test_order_of_input_is_irrelevant(spark):
    texts = random_texts(5, 30)
    mixed = docs(spark, texts).repartition(5).orderBy(F.rand(1))
    assert brute.as_dict(training.train(mixed, SPACE)) == brute.as_dict(training.train(docs(spark, texts), SPACE))


def test_own_trainer(spark):
    """A trainer is any function that yields partial rows."""

    def counting(texts, space):
        from wordspace.functions.text import document_words
        from wordspace.operators.sums import pack

        one = F.struct(F.array(F.lit(0)).alias("dims"), F.array(F.lit(1).cast("bigint")).alias("vals"))
        words = document_words(texts).select(F.col("word").alias("key"), F.lit(1).cast("bigint").alias("weight"))
        return pack(words.withColumn("vec", one), space.size)

    found = brute.as_dict(training.train(docs(spark, ["a b a", "b a"]), SPACE, counting))
    assert found == {"a": {0: 3}, "b": {0: 2}}


def batches(rows, at_once):
    for i in range(0, len(rows), at_once):
        yield pa.RecordBatch.from_arrays([pa.array(rows[i : i + at_once], pa.list_(pa.string()))], ["tokens"])


@pytest.mark.parametrize("ordered", [True, False])
@pytest.mark.parametrize("table_bytes, at_once", [(1, 7), (40 * 8 * 64, 3), (1 << 20, 1000)])
def test_small_tables_push_out_and_lose_nothing(monkeypatch, ordered, table_bytes, at_once):
    """With room for as few as 16 words, and remembering none, the sums stay whole."""
    monkeypatch.setattr(partial, "TABLE_BYTES", table_bytes)
    monkeypatch.setattr(contexts, "WORDS_REMEMBERED", 10)
    monkeypatch.setattr(contexts, "TOKENS_AT_ONCE", 11)
    texts = lines_of(random_texts(6, 25)) + [" ".join(f"u{i % 90}" for i in range(500))]
    rows = [brute.tokens(t) for t in texts]
    total, weights, parts = {}, {}, {}
    for batch in contexts.combine_contexts(SPACE, ordered)(batches(rows, at_once)):
        edges, dims, vals = partial.read_cells(batch.column("vec"))
        names = batch.column("key").to_pylist()
        factors = batch.column("factor").to_pylist() if "factor" in batch.schema.names else [1] * len(names)
        for i, (word, weight) in enumerate(zip(names, batch.column("weight").to_pylist())):
            cells = total.setdefault(word, {})
            weights[word] = weights.get(word, 0) + weight
            parts[word] = parts.get(word, 0) + 1
            for d, v in zip(dims[edges[i] : edges[i + 1]].tolist(), vals[edges[i] : edges[i + 1]].tolist()):
                cells[d] = cells.get(d, 0) + v * factors[i]
    expected = (brute.ordered if ordered else brute.windowed)(texts, SPACE)
    assert {w: {d: v for d, v in c.items() if v} for w, c in total.items()} == expected
    assert sum(weights.values()) == sum(map(len, rows))
    if table_bytes > 1:
        assert parts["hot"] == 1, "the most frequent word leaves a task once"


def test_plan_has_one_shuffle_by_word(spark):
    texts = spark.range(8).selectExpr("id AS doc_id", "'a b' AS text").repartition(8)
    plan = training.train(texts, SPACE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan and "Window" not in plan


def test_merging_keeps_other_columns(spark):
    first = training.train(docs(spark, ["a b a", "b c"]), SPACE)
    tagged = first.withColumns({"tag": F.concat(F.lit("tag "), "key"), "n": F.when(F.col("key") == "a", 7)})
    found = training.train(docs(spark, ["a d"]), SPACE, lexicon=tagged.unionByName(tagged.limit(0)))
    assert {r.key: (r.tag, r.n) for r in found.collect()} == {"a": ("tag a", 7), "b": ("tag b", None), "c": ("tag c", None), "d": (None, None)}
    assert brute.as_dict(found.select("key", "vec")) == brute.as_dict(training.train(docs(spark, ["a d"]), SPACE, lexicon=first))


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_wide_spaces_deal_sentences_by_word(spark, partitions):
    """Hot words, a sentence longer than a vector, and words of one occurrence, in batches and on top of a lexicon."""
    wide = VectorSpace(4099, 6, 2)
    texts = random_texts(1, 6) + TEXTS + [" ".join(f"w{i % 7}" for i in range(1100))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        first = training.train(docs(spark, texts[:4]), wide)
        assert brute.as_dict(first) == brute.ordered(lines_of(texts[:4]), wide)
        assert brute.as_dict(training.train(docs(spark, texts[4:]), wide, lexicon=first)) == brute.ordered(lines_of(texts), wide)
        assert training.train(docs(spark, [None, ""]), wide).count() == 0
        assert brute.as_dict(training.train(docs(spark, ["solo"]), wide)) == {"solo": {}}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_wide_spaces_send_sentences_not_vectors(spark):
    wide, texts = VectorSpace(16000, 48, 3), [" ".join(f"a{i * 50 + j}" for j in range(40)) for i in range(50)]
    dealt = training.from_sentences(docs(spark, texts).coalesce(1), wide)
    assert dealt.filter("vec IS NOT NULL").count() == 0
    assert sum(len(r.places) for r in dealt.collect()) == 2000


@pytest.mark.parametrize("trainer", [training.from_sentences, training.from_windows])
def test_seldom_words_are_sent_as_contexts(spark, trainer):
    """In a narrow space too: what is shuffled, and sorted, are the tokens around a word, not its vector."""
    texts = [" ".join(f"a{i * 50 + j}" for j in range(40)) for i in range(50)]
    dealt = trainer(docs(spark, texts).coalesce(1), VectorSpace(1024, 8, 3))
    assert dealt.filter("vec IS NOT NULL").count() == 0
    assert sum(len(r.places) for r in dealt.collect()) == 2000


@pytest.mark.parametrize("ordered", [True, False])
@pytest.mark.parametrize("size, cells, table_bytes", [(64, 50, 1), (64, 1 << 20, 1 << 20), (4099, 700, 1), (4099, 1 << 20, 1 << 20)])
def test_contexts_are_added_up_in_parts(monkeypatch, ordered, size, cells, table_bytes):
    monkeypatch.setattr(partial, "TABLE_BYTES", table_bytes)
    monkeypatch.setattr(contexts, "CONTEXT_CELLS", cells)
    monkeypatch.setattr(contexts, "SLICE", 97)
    space = VectorSpace(size, 4, 2)
    texts = lines_of(random_texts(6, 25)) + ["solo", " ".join(f"u{i % 90}" for i in range(300))]
    rows = [brute.tokens(t) for t in texts]
    dealt = pa.Table.from_batches(contexts.deal_contexts(space, ordered)(batches(rows, 9)), contexts._DEALT)
    found = {}
    for batch in contexts.add_contexts(space)(iter(dealt.sort_by("key").combine_chunks().to_batches())):
        edges, dims, vals = partial.read_cells(batch.column("vec"))
        for i, word in enumerate(batch.column("key").to_pylist()):
            assert word not in found
            own = slice(edges[i], edges[i + 1])
            found[word] = dict(zip(dims[own].tolist(), vals[own].tolist()))
    assert found == (brute.ordered if ordered else brute.windowed)(texts, space)


def encoded_sum(block, at):
    """The rows of a block, encoded and added up by ``at``."""
    rows, columns = [], ([], [], [])
    for some, code, head, tail in partial.encode(block):
        rows += some.tolist()
        for column, part in zip(columns, ([code] * some.size, head.to_pylist(), tail.to_pylist())):
            column += part
    assert sorted(rows) == list(range(len(block)))
    order = np.argsort(rows)
    kinds = (pa.int32(), pa.binary(), pa.binary())
    sums = np.zeros((at.max() + 1, block.shape[1]), np.int64)
    partial.add_encoded(sums, at, *(pa.array([column[i] for i in order], kind) for column, kind in zip(columns, kinds)))
    return sums, set(columns[0])


@pytest.mark.parametrize("size", [1, 5, 64, 1023, 4099, 70_000])
def test_encoded_vectors_add_up(size):
    rng = np.random.default_rng(1)
    block = np.zeros((60, size), np.int64)
    for i, row in enumerate(block):
        most = [1, 1.2, 4, 30, 200, 40_000, 2**45][i % 7]
        row[:] = np.where(rng.random(size) < [0.001, 0.05, 0.4, 1][i % 4], np.round(rng.normal(0, most, size)), 0)
    at = np.sort(rng.integers(0, 9, 60))
    expected = np.zeros((at.max() + 1, size), np.int64)
    np.add.at(expected, at, block)
    found, codes = encoded_sum(block, at)
    assert (found == expected).all()
    assert size < 1023 or len(codes) > 8


def test_sums_are_sent_in_few_bits(spark):
    """A seldom word of a long sentence goes as its sum, which takes fewer bytes than the sentence."""
    texts = [" ".join(f"word{i * 200 + j}" for j in range(200)) for i in range(10)]
    dealt = training.from_sentences(docs(spark, texts).coalesce(1), VectorSpace(1024, 8, 3))
    rows = dealt.selectExpr("tokens", "length(head) + length(tail) AS bytes").collect()
    assert len(rows) == 2000 and all(r.tokens is None for r in rows)
    assert max(r.bytes for r in rows) < 512


def test_words_of_many_texts_are_summed_before_they_leave():
    """The tokens of many batches are looked at together, so a word leaves once for all of them."""
    rows = [[f"a{i}", f"b{i}", *(f"w{j}" for j in range(200))] for i in range(40)]
    dealt = pa.Table.from_batches(contexts.deal_contexts(VectorSpace(1024, 8), True)(batches(rows, 5)), contexts._DEALT)
    assert dealt.num_rows == 280


@pytest.mark.parametrize("whole", [1, 96 << 20])
def test_sums_of_sentences_beyond_a_byte(spark, monkeypatch, whole):
    monkeypatch.setattr(contexts, "WHOLE_BYTES", whole)
    texts = ["a " * 200 + "b", "c d " * 80, "e f g"]
    rows = [brute.tokens(t) for t in texts]
    dealt = pa.Table.from_batches(contexts.deal_contexts(SPACE, True)(batches(rows, 2)), contexts._DEALT)
    found = {}
    for batch in contexts.add_contexts(SPACE)(iter(dealt.sort_by("key").combine_chunks().to_batches())):
        edges, dims, vals = partial.read_cells(batch.column("vec"))
        for i, word in enumerate(batch.column("key").to_pylist()):
            found[word] = dict(zip(dims[edges[i] : edges[i + 1]].tolist(), vals[edges[i] : edges[i + 1]].tolist()))
    assert found == brute.ordered(texts, SPACE)
