"""Toxicity: features against plain Python, the fit, pairs of sentences, held-out accuracy."""

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordspace.llm import queries, toxicity

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def plain_features(text):
    words = WORD.findall((text or "").encode().lower())
    counts = Counter(("word", w) for w in words)
    counts.update(("pair", *two) for two in zip(words, words[1:]))
    counts.update((n, w[:n]) for w in words for n in toxicity.BEGINNINGS if len(w) >= n)
    return Counter({name: sum(c >= 1 << level for level in range(toxicity.LEVELS)) for name, c in counts.items()})


ODD = [None, "", "..", "a", "Idiot idiot IDIOT idiot", "é É", "one. two! three?\nfour", "trash trashy trashcan", "word " * 100_000]


def test_features():
    random.seed(2)
    texts = ODD + [" ".join(random.choices(["alpha", "alphabet", "Beta.", "x", "été"], k=random.randrange(30))) for _ in range(50)]
    got = [Counter() for _ in texts]
    for hashes, owner in toxicity._kinds(pa.array(texts, pa.string())):
        owner, features = toxicity._counted(hashes, owner)
        assert np.unique(np.column_stack((owner.astype(np.uint64), features)), axis=0).shape[0] == owner.size
        for of, base in zip(owner.tolist(), (features & ~np.uint64(3)).tolist()):
            got[of][base] += 1
    for text, counts in zip(texts, got):
        assert sorted(counts.values()) == sorted(plain_features(text).values()), text
    assert got[2] == got[0] == Counter()


def test_chosen_features_are_the_bits():
    texts = pa.array(["alpha beta", "alpha alpha", None, "gamma"])
    chosen = np.unique(np.concatenate([toxicity._counted(*kind)[1] for kind in toxicity._kinds(pa.array(["alpha alpha"]))]))
    bits = toxicity._unpacked(toxicity._bits(texts, chosen).to_pylist(), chosen.size)
    assert bits[1].all() and not bits[2].any() and not bits[3].any()
    assert 0 < bits[0].sum() < chosen.size


def test_fit_is_the_least_loss():
    random = np.random.default_rng(1)
    x = (random.random((400, 6)) < 0.4).astype(np.uint8)
    y = (random.random(400) < 1 / (1 + np.exp(-(2.0 * x[:, 0] - 1.5 * x[:, 1] - 0.5)))).astype(float)
    a, b = (random.random((2, 50, 6)) < 0.5).astype(np.uint8)

    def loss(start, w, fair):
        z = x @ w + start
        return (np.logaddexp(0, z) - y * z).sum() + 0.5 / 2 * w @ w + fair / 2 * (((a.astype(float) - b) @ w) ** 2).sum()

    for fair in (0.0, 3.0):
        start, w = toxicity.fit(x, y, a, b, ridge=0.5, fair=fair)
        least = loss(start, w, fair)
        for _ in range(200):
            assert loss(start + random.normal(0, 0.01), w + random.normal(0, 0.01, 6), fair) >= least


def test_fit_without_rows_or_of_one_label():
    none = np.zeros((0, 3), np.uint8)
    start, w = toxicity.fit(none, np.zeros(0), none, none)
    assert start == pytest.approx(0.0) and not w.any()
    start, w = toxicity.fit(np.ones((5, 3), np.uint8), np.ones(5), none, none)
    assert start > 2 and not w.any()


def test_swapped_sentences():
    others = toxicity.swaps(("women men girls", "old young"))
    pairs = list(toxicity.swapped("The Women came. Nothing here! old MEN\nmen", others))
    assert [said for said, _ in pairs] == [b"the women came", b"old men", b"men"]
    for said, turned in pairs:
        for one, other in zip(said.split(), turned.split()):
            assert other in others[one] if one in others else other == one
    assert pairs == list(toxicity.swapped("the women came. old men. men", others))
    assert list(toxicity.swapped(None, others)) == []
    with pytest.raises(ValueError):
        toxicity.swaps(("women",))


def cases():
    """Labelled texts in which one group is named far more often where there is an insult."""
    random.seed(4)
    verbs, places = ["met", "saw", "sang", "left", "came"], ["market", "park", "school", "river", "hall"]
    out = []
    for i in range(600):
        toxic = i % 3 == 0
        group = random.choices(["muslims", "christians", "jews", "hindus"], [8, 1, 1, 1] if toxic else [1, 4, 4, 4])[0]
        text = f"{group} {random.choice(verbs)} at the {random.choice(places)}."
        out.append((i, text + (" What worthless scum." if toxic and i % 2 else ""), int(toxic)))
    return out


def test_neutral_mentions_are_spared(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    neutral = [f"muslims {v} at the {p}." for v in ("met", "sang") for p in ("park", "hall")]
    rude = ["hindus met at the park. What worthless scum."]
    scores = {}
    for fair in (0.0, 10.0):
        model = toxicity.train(docs, labels, fair=fair)
        scores[fair] = model.score(pa.array(neutral)).max(), model.score(pa.array(rude)).min()
    assert scores[0.0][0] >= toxicity.TOXIC
    assert scores[10.0][0] < toxicity.TOXIC
    assert scores[10.0][1] >= toxicity.TOXIC


def test_odd_tables(spark):
    schema = "doc_id long, text string, key string, label string, hash string, score string"
    docs = spark.createDataFrame(
        [(1, None, "?", "?", "?", "?"), (1, "", "?", "?", "?", "?"), (None, "scum", "?", "?", "?", "?"), (2, "fine " * 9, "?", "?", "?", "?")], schema
    )
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (2, 7), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == 4
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.collect())
    none = toxicity.train(docs.filter("false"), labels.filter("false"))
    assert toxicity.score(docs, none).count() == 4
    assert toxicity.score(docs.filter("false"), none).count() == 0


def test_sample_bounds_what_is_collected(spark, monkeypatch):
    docs = spark.range(50).select(F.lit(1).alias("doc_id"), F.concat(F.lit("scum "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(1, 0), (1, 1)], "doc_id int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda x, y, a, b, **more: seen.append((x.shape[0], y.size)) or (0.0, np.zeros(x.shape[1])))
    toxicity.train(docs, labels, sample=30)
    assert seen == [(30, 30)]


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("no tables")
    found = queries.op12_toxicity(spark, sf_dir)
    assert found.count() == 1000
    rows = found.join(queries.table(spark, sf_dir, "labels"), "doc_id").filter("held_out").collect()
    wrong = sum(r.predicted and not r.toxic for r in rows)
    caught = sum(r.predicted and r.toxic for r in rows)
    assert wrong <= 1 and caught >= 0.4 * sum(r.toxic for r in rows)
