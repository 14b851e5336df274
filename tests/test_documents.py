import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from test_training import SPACE, docs, random_texts
from wordspace.operators import documents, similarity, topics, training
from wordspace.space import VectorSpace

LEXICON_TEXTS = random_texts(7, 30) + ["solo"]
TEXTS = random_texts(8, 12) + ["", "unknown words only", "solo", "hot solo unknown"]


@pytest.fixture(scope="module")
def lexicon(spark):
    return training.train(docs(spark, LEXICON_TEXTS), SPACE, training.from_windows).cache()


@pytest.fixture(scope="module")
def known():
    return brute.windowed(LEXICON_TEXTS, SPACE)


def dense(rows):
    found = {}
    for r in rows.collect():
        vec = np.zeros(SPACE.size)
        vec[r.vec.dims] = r.vec.vals
        found[r.key] = (r.weight, vec)
    return found


def test_mean(lexicon, known):
    row = documents.mean_vector(lexicon, SPACE).first()
    expected = brute.mean(known)
    assert row.weight == len(known)
    assert dict(zip(row.vec.dims, row.vec.vals)) == pytest.approx(expected)


@pytest.mark.parametrize("room", [1, 64 << 20], ids=["rare words joined", "all words sent"])
def test_text_vectors(spark, lexicon, known, monkeypatch, room):
    monkeypatch.setattr(documents, "FREQUENT_BYTES", room)
    found = dense(documents.text_vectors(docs(spark, TEXTS), lexicon, SPACE))
    expected = {i: brute.text_vector(brute.tokens(t), known, SPACE.size) for i, t in enumerate(TEXTS)}
    expected = {i: v for i, v in expected.items() if v}
    assert found.keys() == expected.keys()
    for i, (n, vec) in expected.items():
        assert found[i][0] == n
        assert found[i][1] == pytest.approx(np.array(vec), abs=1e-9)


@pytest.mark.parametrize("sparse", [1, 1000], ids=["as cells", "as places"])
def test_rare_words_in_blocks(spark, lexicon, known, monkeypatch, sparse):
    """Blocks of few texts, words listed a few at a time, vectors in parts of a block."""
    monkeypatch.setattr(documents, "FREQUENT_BYTES", 1)
    monkeypatch.setattr(documents, "BLOCK_BYTES", 8 * SPACE.size * 2)
    monkeypatch.setattr(documents, "BLOCK_TOKENS", 5)
    monkeypatch.setattr(documents, "OUTPUT_CELLS", 1)
    monkeypatch.setattr(documents, "SPARSE", sparse)
    texts = TEXTS + random_texts(9, 30)
    rows = docs(spark, texts).selectExpr("nullif(doc_id % 20, 0) AS doc_id", "text")
    found = dense(documents.text_vectors(rows, lexicon, SPACE))
    for i in range(20):
        own = [w for t in texts[i::20] for w in brute.tokens(t)]
        n, vec = brute.text_vector(own, known, SPACE.size)
        assert found[i or None][0] == n and found[i or None][1] == pytest.approx(np.array(vec), abs=1e-9)
    assert len(found) == 20


def test_vectors_of_texts_are_not_shuffled(spark, lexicon):
    """A word's vector goes once to each block that has it, and none of a text goes anywhere."""
    plan = documents.text_vectors(docs(spark, TEXTS), lexicon, SPACE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow") and "reals" not in plan


@pytest.mark.parametrize("values", [[1, -2, 300], [1, -(1 << 40), 7], [0.5, -1.25, 3.0]])
@pytest.mark.parametrize("dims, size", [([0, 3, 5], 6), ([2, 290, 999], 1000), ([1, 70_000, 99_999], 100_000)])
def test_compressed_vectors(values, dims, size):
    kind = pa.struct([("dims", pa.list_(pa.int32())), ("vals", pa.list_(pa.array(values).type))])
    rows = pa.array([{"dims": dims, "vals": values}, {"dims": [], "vals": []}], kind)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), rows], ["word", "vec"])
    (out,) = documents._compress(size)([batch])
    for i, expected in enumerate((dict(zip(dims, values)), {})):
        row = out.slice(i, 1).to_pylist()[0]
        vec = np.zeros(size, pa.array(values).type.to_pandas_dtype())
        where, got = documents._places_and_values(pa.Codec("zstd"), row["kind"], row["cells"], pa.py_buffer(row["vec"]), size)
        vec[where] += got.astype(vec.dtype)
        assert {int(d): vec[d] for d in np.flatnonzero(vec)} == expected
        assert row["factor"] == pytest.approx(1 / np.linalg.norm(values) if expected else 0.0)


def test_frequent_words_are_sent_as_narrow_as_they_are(lexicon, known):
    row_of, factors, matrix = documents._matrix(lexicon, SPACE.size)
    assert matrix.dtype == np.int16 and row_of.keys() == known.keys()
    for word, i in row_of.items():
        assert {int(d): matrix[i, d] for d in np.flatnonzero(matrix[i])} == known[word]
        assert factors[i] == pytest.approx(1 / np.linalg.norm(matrix[i].astype(float)) if known[word] else 0)


@pytest.mark.parametrize("cells, compressed", [(6, "u1b0"), (240, "u1b1"), (2, "u4b0")])
def test_signs_take_a_bit_each(cells, compressed):
    """Vectors of 1 and -1 alone, as they stand where compressing them would make them longer."""
    size = 100_000 if compressed.startswith("u4") else 1024
    dims = [0, 99_999] if size == 100_000 else list(range(0, 4 * cells, 4))
    vals = [1 - 2 * (i % 3 == 0) for i in range(cells)]
    kind = pa.struct([("dims", pa.list_(pa.int32())), ("vals", pa.list_(pa.int64()))])
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([{"dims": dims, "vals": vals}], kind)], ["word", "vec"])
    ((row,),) = (out.to_pylist() for out in documents._compress(size)([batch]))
    assert row["kind"] == compressed
    where, got = documents._places_and_values(pa.Codec("zstd"), row["kind"], row["cells"], row["vec"], size)
    assert where.tolist() == dims and got.tolist() == vals
    assert len(row["vec"]) <= cells * int(compressed[1]) + -(-cells // 8)


def test_rows_of_a_block_are_joined(monkeypatch):
    schema = pa.schema([("block", pa.int32()), ("at", pa.list_(pa.int32())), ("vec", pa.binary())])
    rows = [{"block": i % 3, "at": [i, i + 1], "vec": bytes([i % 256]) * 10} for i in range(1000)]
    batches = pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=70)
    for room in (1, 1000, 1 << 20):
        monkeypatch.setattr(documents, "JOINED_BYTES", room)
        monkeypatch.setattr(documents, "HELD_BYTES", 3 * room)
        joined = list(documents._join_rows(schema)(iter(batches)))
        assert room < 1 << 20 or len(joined) == 3
        for batch in joined:
            assert {r["block"] for b in documents._part_rows([batch]) for r in b.to_pylist()} == set(batch.column("block").to_pylist())
        found = [r for b in documents._part_rows(joined) for r in b.to_pylist()]
        assert sorted(found, key=lambda r: r["at"]) == rows


@pytest.mark.parametrize("compressed", [0, 7])
def test_more_words_are_sent_compressed(spark, lexicon, known, monkeypatch, compressed):
    """Words beyond those of the matrix are not joined, whose vectors would go to every block that has them."""
    monkeypatch.setattr(documents, "FREQUENT_BYTES", 1)
    monkeypatch.setattr(documents, "COMPRESSED", compressed)
    found = documents._frequent(documents.each(docs(spark, TEXTS), documents.token_array(F.col("text")), "word", "doc_id"), SPACE)
    assert found[0] == "hot" and len(found) == len(set(found)) == min(16 * (1 + compressed), len({w for t in TEXTS for w in brute.tokens(t)}))
    vectors = dense(documents.text_vectors(docs(spark, TEXTS), lexicon, SPACE))
    for i, text in enumerate(TEXTS):
        n, vec = brute.text_vector(brute.tokens(text), known, SPACE.size) or (0, None)
        assert (i in vectors) == bool(n)
        if n:
            assert vectors[i][0] == n and vectors[i][1] == pytest.approx(np.array(vec), abs=1e-9)


def test_words_that_a_lexicon_repeats(spark, lexicon, monkeypatch):
    """A word that is not frequent counts with every row it has."""
    monkeypatch.setattr(documents, "FREQUENT_BYTES", 1)
    texts = docs(spark, TEXTS + ["w0 w1 w2 w3"])
    twice = lexicon.unionByName(lexicon.filter("key IN ('w0', 'w1', 'w2', 'w3')"))
    weights = []
    for compressed in (0, 7):
        monkeypatch.setattr(documents, "COMPRESSED", compressed)
        weights.append({r.key: r.weight for r in documents.text_vectors(texts, twice, SPACE).collect()})
    assert weights[0] == weights[1]


def test_texts_of_one_key_add_up(spark, lexicon, known):
    rows = spark.createDataFrame([("x", TEXTS[0]), ("x", TEXTS[1])], "doc_id string, text string")
    n, vec = dense(documents.text_vectors(rows, lexicon, SPACE))["x"]
    count, expected = brute.text_vector(brute.tokens(TEXTS[0] + " " + TEXTS[1]), known, SPACE.size)
    assert n == count and vec == pytest.approx(np.array(expected), abs=1e-9)


def test_lines_looked_up_whole(spark, lexicon, known):
    rows = docs(spark, ["hot\nw1\nw2 w3\nhot"])
    n, vec = dense(documents.text_vectors(rows, lexicon, SPACE, unit="line"))[0]
    count, expected = brute.text_vector(["hot", "w1", "hot"], known, SPACE.size)
    assert n == count and vec == pytest.approx(np.array(expected), abs=1e-9)


def test_empty_lexicon(spark):
    empty = training.empty_lexicon(spark)
    assert documents.text_vectors(docs(spark, TEXTS), empty, SPACE).count() == 0
    assert documents.mean_vector(empty, SPACE).count() == 0


@pytest.fixture(scope="module")
def vectors(spark, lexicon):
    return documents.text_vectors(docs(spark, TEXTS), lexicon, SPACE).cache()


@pytest.mark.parametrize("block", [64 * 8 * 3, 32 << 20], ids=["many blocks", "one block"])
def test_all_similarities(vectors, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK_BYTES", block)
    vecs = {k: v for k, (_, v) in dense(vectors).items()}
    found = {(r.left_key, r.right_key): r.similarity for r in similarity.all_similarities(vectors, vectors, SPACE).collect()}
    assert found.keys() == {(a, b) for a in vecs for b in vecs}
    for (a, b), s in found.items():
        assert s == pytest.approx(brute.cosine(vecs[a], vecs[b]), abs=1e-9)
        assert found[b, a] == pytest.approx(s)
    assert all(found[a, a] == pytest.approx(1) for a in vecs)


@pytest.mark.parametrize("ascending", [False, True])
def test_best_matches(vectors, monkeypatch, ascending):
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 64 * 8 * 3)
    vecs = {k: v for k, (_, v) in dense(vectors).items()}
    found = {}
    for r in similarity.all_similarities(vectors, vectors, SPACE, 4, ascending).collect():
        found.setdefault(r.left_key, {})[r.rank] = r.right_key
    for a in vecs:
        sign = 1 if ascending else -1
        ranked = sorted(vecs, key=lambda b: (round(sign * brute.cosine(vecs[a], vecs[b]), 9), b))
        assert [found[a][i] for i in range(1, 5)] == ranked[:4]


def test_equal_similarities_rank_by_name(spark, vectors):
    one = vectors.limit(1)
    copies = one.selectExpr("explode(array('d', 'b', 'c', 'a')) AS key", "vec")
    best = similarity.all_similarities(one, copies, SPACE, top=2).collect()
    assert sorted((r.rank, r.right_key) for r in best) == [(1, "a"), (2, "b")]


def clustered(spark, centres, each, seed=3):
    """Vectors close to a few centres, copies, a zero vector and a missing one."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, SPACE.size))
    rows = {f"v{i}": base[i % centres] + 0.2 * rng.normal(size=SPACE.size) for i in range(centres * each)}
    rows |= {f"copy{i}": rows["v0"] for i in range(5)} | {"zero": np.zeros(SPACE.size)}
    table = [(k, (list(range(SPACE.size)), [float(x) for x in v])) for k, v in rows.items()] + [("none", None)]
    return spark.createDataFrame(table, "key string, vec struct<dims: array<int>, vals: array<double>>").cache(), rows


@pytest.mark.parametrize("least", [0.97, 0.9, 0.0, -1.0])
@pytest.mark.parametrize("block", [4, 1000])
def test_pairs_above_a_threshold(spark, least, block):
    table, rows = clustered(spark, 5, 8)
    other, more = clustered(spark, 3, 4, seed=4)
    other, more = other.filter("key <> 'v3'").unionByName(table.filter("key = 'v1'")).cache(), more | {"v1": rows["v1"]}
    for right, vecs in ((table, rows), (other, None)):
        if vecs is None:
            listed = [(r.key, np.array(r.vec.vals)) for r in other.collect() if r.vec]
        else:
            listed = list(vecs.items())
        expected = sorted(
            (a, b, round(s, 9)) for a, u in rows.items() if u.any() for b, v in listed if v.any() and (s := brute.cosine(u, v)) >= least - 1e-12
        )
        found = similarity.similar_pairs(table, right, SPACE, least, block).collect()
        assert sorted((r.left_key, r.right_key, round(r.similarity, 9)) for r in found if r.similarity >= least) == expected


def test_areas_that_cannot_hold_a_pair_never_meet(spark, monkeypatch):
    table, _ = clustered(spark, 8, 16)
    seen = []
    near = similarity.near_areas
    monkeypatch.setattr(similarity, "near_areas", lambda left, right, least: seen.append((len(left) * len(right), near(left, right, least))) or seen[-1][1])
    assert similarity.similar_pairs(table, table, SPACE, 0.9, 8).count() >= 8 * 16
    every, kept = seen[0]
    assert len(kept) < every / 3


def test_no_pairs_in_empty_tables(spark):
    table, _ = clustered(spark, 2, 2)
    empty = table.filter("key = 'x'")
    for left, right in ((table, empty), (empty, table), (table.filter("key IN ('zero', 'none')"), table)):
        assert similarity.similar_pairs(left, right, SPACE, 0.5).collect() == []


def test_lists(vectors):
    pairs = similarity.all_similarities(vectors, vectors, SPACE).cache()
    by_pair = {(r.left_key, r.right_key): r.similarity for r in pairs.collect()}
    names = sorted({a for a, _ in by_pair})
    for r in similarity.similarity_lists(pairs).collect():
        assert r.similarities == [by_pair[r.left_key, b] for b in names]


@pytest.mark.parametrize("room", [1, 64 << 20], ids=["join", "broadcast"])
def test_given_pairs(spark, vectors, monkeypatch, room):
    monkeypatch.setattr(similarity, "FREQUENT_BYTES", room)
    vecs = {k: v for k, (_, v) in dense(vectors).items()}
    pairs = spark.createDataFrame([(0, 1), (1, 0), (0, 0), (0, 999)], "a int, b int")
    found = {(r.a, r.b): r.similarity for r in similarity.compare(vectors, pairs, SPACE).collect()}
    assert found[0, 1] == pytest.approx(brute.cosine(vecs[0], vecs[1])) and found[0, 1] == pytest.approx(found[1, 0])
    assert found[0, 0] == pytest.approx(1) and found[0, 999] is None
    many = spark.createDataFrame([(a, b) for a in range(20) for b in [0, *range(20, 40)]], "a int, b int")
    assert similarity.compare(vectors, many, SPACE).count() == 20 * 21
    got = {r.a: r.similarity for r in similarity.compare(vectors, many, SPACE).filter("b = 0").collect()}
    assert len(got) == 20
    for a, s in got.items():
        assert s == (pytest.approx(brute.cosine(vecs[a], vecs[0])) if a in vecs else None)


def test_topics(spark, lexicon, known):
    rows = spark.createDataFrame(
        [(" a\nb ", TEXTS[0]), ("b", TEXTS[1]), ("c", "nothing known"), ("a a", TEXTS[2])], "topics string, body string"
    )
    found = dense(topics.topic_vectors(rows, lexicon, SPACE))
    assert found.keys() == {"a", "b"}
    expected = {"a": [0, 2, 2], "b": [0, 1]}
    for topic, numbers in expected.items():
        n, vec = brute.text_vector([w for i in numbers for w in brute.tokens(TEXTS[i])], known, SPACE.size)
        assert found[topic][0] == n and found[topic][1] == pytest.approx(np.array(vec), abs=1e-9)
    trained = topics.topic_vectors(rows, lexicon, SPACE)
    merged = dense(topics.merge_topics(trained, trained, SPACE))
    for topic, (n, vec) in found.items():
        assert merged[topic][0] == 2 * n and merged[topic][1] == pytest.approx(2 * vec, abs=1e-9)


@pytest.mark.parametrize("few", [512, 1], ids=["counted first", "in blocks"])
def test_sets_of_topics_either_way(spark, lexicon, known, monkeypatch, few):
    monkeypatch.setattr(topics, "FEW_SETS", few)
    asked = []
    monkeypatch.setattr(topics, "text_vectors", lambda *a, **k: asked.append(1) or documents.text_vectors(*a, **k))
    rows = spark.createDataFrame([(f"t{i % 3} all", t) for i, t in enumerate(TEXTS)] + [(None, "hot"), ("t1 all", None)], "topics string, body string")
    found = dense(topics.topic_vectors(rows, lexicon, SPACE))
    assert bool(asked) == (few == 1)
    for topic, own in {"all": TEXTS, **{f"t{i}": TEXTS[i::3] for i in range(3)}}.items():
        n, vec = brute.text_vector([w for t in own for w in brute.tokens(t)], known, SPACE.size)
        assert found[topic][0] == n and found[topic][1] == pytest.approx(np.array(vec), abs=1e-9)


def test_words_of_topics_are_counted_before_they_meet_vectors(spark, lexicon):
    """No vector is dealt to blocks of texts."""
    rows = spark.createDataFrame([("a", t) for t in TEXTS], "topics string, body string")
    plan = topics.topic_vectors(rows, lexicon, SPACE)._jdf.queryExecution().optimizedPlan().toString()
    assert "block" not in plan and "count(1)" in plan


def test_assign(spark, vectors):
    copies = vectors.selectExpr("concat('t', key) AS key", "weight", "vec")
    best = topics.assign_topics(vectors, copies, SPACE, top=1).collect()
    vecs = {k: v for k, (_, v) in dense(vectors).items()}
    for r in best:
        assert brute.cosine(vecs[r.left_key], vecs[int(r.right_key[1:])]) == pytest.approx(1)


def test_best_of_rows_with_ties_and_gaps():
    rng = np.random.default_rng(5)
    sims = np.round(rng.random((60, 40)), 1)
    sims[:5] = np.nan
    sims[5:10, 30:] = np.nan
    sims[10, 3:] = np.nan
    names = rng.permutation(40)
    for top in (1, 7, 40, 99):
        for ascending in (False, True):
            rows, cols = similarity._best(sims, names, top, ascending)
            for i in range(60):
                key = lambda j: (np.isnan(sims[i, j]), np.nan_to_num(sims[i, j] if ascending else -sims[i, j]), names[j])  # noqa: E731, B023
                assert cols[rows == i].tolist() == sorted(range(40), key=key)[:top]


def test_blocks_and_broadcasts_agree(spark, monkeypatch):
    rng = random.Random(8)
    vectors = [(f"k{i}", ([0, 1, 2], [float(rng.randint(-2, 2)) for _ in range(3)])) for i in range(50)]
    rows = spark.createDataFrame(vectors, "key string, vec struct<dims:array<int>,vals:array<double>>")
    space = VectorSpace(size=4, k=2)

    def best():
        found = similarity.all_similarities(rows, rows, space, top=6).collect()
        return sorted((r.left_key, r["rank"], r.right_key, r.similarity and round(r.similarity, 9)) for r in found)

    once = best()
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 8 * 4 * 9)
    assert best() == once
    monkeypatch.setattr(similarity, "BROADCASTS", 0)
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 8 * 16)
    assert best() == once
    assert similarity.all_similarities(rows, rows, space).count() == 2500
