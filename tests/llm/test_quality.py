"""Quality classifier: features against plain Python, tables, held-out accuracy."""

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wordspace.llm import queries, quality

SCHEMA = "doc_id bigint, text string, key string, score string, label string"


def plain(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    lowered = [w.lower() for w in words]
    lines = re.findall(rb"[^\n\r]+", raw)
    n, size = max(len(words), 1), max(len(raw), 1)
    stops = sum(w[-1:] in (b".", b"!", b"?") for w in words)
    symbol = rb"[^0-9A-Za-z\x80-\xff\x20\x09-\x0d.!?,;:'\"()-]"
    p = np.array(list(Counter(raw).values())) / size
    top = lambda x: max(Counter(x).values(), default=0)
    return [
        np.log1p(len(words)), sum(map(len, words)) / n, sum(len(w) > 12 for w in words) / n, sum(len(w) < 4 for w in words) / n,
        len(re.findall(rb"[0-9]", raw)) / size, len(re.findall(rb"[A-Z]", raw)) / size, sum(b >= 128 for b in raw) / size,
        len(re.findall(rb"[.!?,;:'\"()-]", raw)) / size, len(re.findall(symbol, raw)) / size,
        sum(bool(re.search(symbol, w)) for w in words) / n, sum(not re.search(rb"[0-9A-Za-z\x80-\xff]", w) for w in words) / n,
        stops / n, np.log1p(len(words) / (stops + 1)), len(set(lowered)) / n, top(lowered) / n,
        sum(a == b for a, b in zip(lowered, lowered[1:])) / n, np.log1p(len(lines)), np.log1p(len(words) / max(len(lines), 1)),
        1 - len(set(lines)) / len(lines) if lines else 0, top(lines) / len(lines) if len(lines) > 1 else 0,
        -(p * np.log2(p)).sum() if raw else 0,
    ]


ODD = [None, "", " ", "\n\n", "a", "A a a", "x y\nx y\r\nz", "é É 日本 ...", "| $$$ % 12,5 Abc! (d) -", "word " * 50_000, "line one\nline one\nline two"]


def test_features():
    random.seed(1)
    texts = ODD + ["".join(random.choices("ab cD é.\n!$|9,", k=random.randrange(200))) for _ in range(100)]
    got = quality.features(pa.array(texts, pa.string()))
    assert got.shape == (len(texts), len(quality.FEATURES))
    for text, row in zip(texts, got):
        assert row == pytest.approx(plain(text), abs=1e-12), text


def test_tables_add_up_to_the_score():
    random = np.random.default_rng(3)
    x = random.random((4000, 3))
    y = ((x[:, 0] > 0.6) | ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5))).astype(float)
    model = quality.fit(x, y)
    assert {1, 2} in [set(p) for p in model.pairs]
    fresh = random.random((2000, 3))
    wanted = (fresh[:, 0] > 0.6) | ((fresh[:, 1] > 0.5) ^ (fresh[:, 2] > 0.5))
    assert ((model.score(fresh) > 0.5) == wanted).mean() > 0.9


@pytest.mark.parametrize("y", [[], [1.0] * 30, [0.0] * 30])
def test_labels_of_one_kind(y):
    model = quality.fit(np.random.default_rng(1).random((len(y), 4)), np.array(y))
    scores = model.score(np.random.default_rng(2).random((5, 4)))
    assert np.all((scores > 0) & (scores < 1))
    if y:
        assert np.all((scores > 0.5) == (y[0] == 1))


def test_odd_rows(spark):
    rows = [(i, t, "k", "s", "l") for i, t in enumerate(ODD)] + [(None, None, None, None, None), (1, "", "k", "s", "l")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(11)] + [(3, None, 0), (None, 1, 0), (4, 0, 1), (99, 1, 0), (2, 7, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    found = quality.score(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in found)
    empty = docs.limit(0)
    assert quality.score(empty, quality.train(empty, labels.limit(0))).count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * i) for i in range(300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, quality int")
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda x, y: sizes.append(x.shape))
    quality.train(docs, labels, sample=40)
    assert sizes == [(40, len(quality.FEATURES))]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_held_out_accuracy(spark):
    found = queries.op2_quality_classifier(spark, "/root/testdata/sf0.1").filter("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = found.join(labels, "doc_id").select("quality", "predicted").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05
