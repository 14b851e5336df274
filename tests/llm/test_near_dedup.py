"""Near-duplicate classes against all pairs in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wordspace.llm import near_dedup

SCHEMA = "doc_id bigint, text string, mark string, label string, kept string, id string"


def shingles(text):
    own = re.findall("[^\x20\x09-\x0d]+", text or "")
    own = [w.translate({c: c + 32 for c in range(65, 91)}) for w in own]
    return Counter(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else Counter()


def brute(texts, threshold=near_dedup.THRESHOLD):
    """Class number of each text; equal texts are one class."""
    sets = [shingles(t) for t in texts]
    df = Counter(x for s in sets for x in s)
    rare = {x: 1 + near_dedup.RARITY * min(1, np.log1p(len(texts) / n) / np.log1p(len(texts))) for x, n in df.items()}
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (texts[i] or "") == (texts[j] or ""):
                parent[root(i)] = root(j)
            elif common := a & b:
                low = sum(n * rare[x] for x, n in common.items())
                if low / sum(n * rare[x] for x, n in (a | b).items()) >= threshold:
                    parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def check(spark, texts):
    rows = spark.createDataFrame([(i, t, "m", "l", "k", "i") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in near_dedup.classes(rows).collect()}
    want = brute(texts)
    first, size = {}, Counter(want)
    for i, label in enumerate(want):
        first.setdefault(label, i)
    assert len(got) == len(texts)
    for i, label in enumerate(want):
        assert (got[i].class_id, got[i].class_size, got[i].kept) == (first[label], size[label], first[label] == i), i


def words(n):
    return [f"w{random.randrange(400)}" for _ in range(n)]


def test_copies_with_changes(spark):
    random.seed(11)
    texts = []
    for _ in range(12):
        source = words(random.choice([30, 120, 400]))
        for _ in range(8):
            own = list(source)
            for _ in range(random.randrange(12)):
                own[random.randrange(len(own))] = "changed" + str(random.randrange(10**6))
            texts.append(" ".join(own))
    texts += [" ".join(words(100)) for _ in range(60)]
    shared = words(60)
    texts += [" ".join(words(50) + shared + words(50)) for _ in range(80)]
    random.shuffle(texts)
    check(spark, texts)


def test_a_large_group_of_near_copies(spark):
    random.seed(12)
    source = words(200)
    texts = []
    for i in range(500):
        own = list(source)
        own[random.randrange(200)] = f"only{i}"
        texts.append(" ".join(own))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = near_dedup.classes(rows).collect()
    assert {r.class_id for r in found} == {0}
    assert {r.n_links for r in found} == {499}


def test_odd_texts(spark):
    long = " ".join(words(300_000))
    check(spark, [None, "", "", " \n", "a", "A", "a b", "a  b", "a b c d e", "a b c d e f", "x " * 50, "x " * 51, "é É", long, long + " end", long[::-1]])


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (None, "z"), (5, None)]
    docs = spark.createDataFrame([(*r, "m", "l", "k", "i") for r in rows], SCHEMA)
    found = sorted(map(tuple, near_dedup.classes(docs).collect()), key=repr)
    assert sum(r[4] for r in found) == 3 and [r[1] for r in found if r[4]].count(1) == 1
    left = near_dedup.drop_near(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(1, "a b c d e f"), (None, "z"), (5, None)], key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_dedup.classes(docs).count() == 0 and near_dedup.drop_near(docs).count() == 0


def test_samples_agree_as_often_as_the_similarity():
    random.seed(13)
    a = words(400)
    b = a[:300] + words(100)
    rare = np.ones((2, 1 << 20), np.float32)
    column = pa.array([" ".join(a), " ".join(b)])
    text, shingle, often = near_dedup.shingles(column)
    begins = np.searchsorted(text, [0, 1])
    samples = near_dedup.Sampler(4000)(begins, shingle, near_dedup.weights(shingle, often, rare))
    common, total = (sum((shingles(column[0].as_py()) & shingles(column[1].as_py())).values()), sum((shingles(column[0].as_py()) | shingles(column[1].as_py())).values()))
    wanted = common / total
    assert (samples[0] == samples[1]).mean() == pytest.approx(wanted, abs=0.03)


def test_large_buckets_are_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "TEXT_BLOCK", 4000)
    random.seed(14)
    source = words(150)
    texts = [" ".join(source[:i] + [f"q{i}"] + source[i + 1 :]) for i in range(40)] + [" ".join(words(80)) for _ in range(20)]
    check(spark, texts)
